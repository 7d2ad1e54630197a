"""Queries of the training-data problems."""

from pyspark.sql import functions as F

from opinark.llm import components, copies, cutoffs, leakage, overlap, packing, sentences, setjoin, spectral, variety
from opinark.plans.registry import Registry
from opinark.runtime import cut, hot_join, item_key, name_key, scratch_path, strip, table

llm = Registry()

#: Deliveries that the ledger query takes one after the other.
LEDGER_BATCHES = 2


# Problem 1


def _ledger(spark, sf_dir):
    rows = table(spark, sf_dir, "reviews_cleaning2").select("row_id", "sentence_text")
    keyed = cut(copies.keyed_rows(rows, "row_id", "sentence_text"), "keyed")
    lo, hi = keyed.agg(F.min("row_id"), F.max("row_id")).first()
    path = scratch_path(spark, "ledger")
    edges = [lo + (hi + 1 - lo) * i // LEDGER_BATCHES for i in range(LEDGER_BATCHES + 1)] if lo is not None else []
    for a, b in zip(edges, edges[1:]):  # each delivery opens the ledger that the one before left
        copies.Ledger(spark, path).add_keyed(keyed.where((F.col("row_id") >= a) & (F.col("row_id") < b)))
    return keyed, cut(copies.Ledger(spark, path).records(), "records")


@llm.query("p1_found")
def p1_found(spark, sf_dir):
    keyed, resolved = _ledger(spark, sf_dir)
    return copies.memberships(keyed, resolved).where("row_id <> first_row_id")


@llm.query("p1_records")
def p1_records(spark, sf_dir):
    """Every distinct record with its number of copies and its earliest row."""
    _, resolved = _ledger(spark, sf_dir)
    return copies.records(resolved).select("first_row_id", "n_copies")


# Problem 4


def _scored(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all").select("row_id", "category_name", "gate_confidence")
    return cutoffs.scored_rows(rows, table(spark, sf_dir, "keep_targets"), "category_name", "gate_confidence", "category_name", "keep_fraction")


_P4_SCORED = """
scored AS (
  SELECT k.category_name, k.keep_fraction, a.row_id, a.gate_confidence AS score
  FROM ate_all a JOIN keep_targets k
    ON translate(lower(trim(a.category_name)), ' -', '__') = translate(lower(trim(k.category_name)), ' -', '__')
  WHERE a.gate_confidence IS NOT NULL AND NOT isnan(a.gate_confidence) AND a.gate_confidence BETWEEN 0 AND 1),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY category_name ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS at_or_above,
         count(*) OVER (PARTITION BY category_name) AS n_scored
  FROM scored),
cut AS (
  SELECT category_name, max(score) AS cutoff, any_value(n_scored) AS n_scored FROM ranked
  WHERE at_or_above * 100 >= n_scored * CAST(round(keep_fraction * 100) AS BIGINT) GROUP BY 1)
"""


@llm.query("p4_found", f"WITH {_P4_SCORED} SELECT s.category_name, s.row_id FROM scored s JOIN cut c ON s.category_name = c.category_name AND s.score >= c.cutoff")
def p4_found(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return cutoffs.kept_rows(scored, cutoffs.cutoffs(scored)).select(F.col("source_name").alias("category_name"), "row_id")


@llm.query(
    "p4_cutoffs",
    f"""WITH {_P4_SCORED} SELECT c.category_name, CAST(c.n_scored AS BIGINT) AS n_scored, count(*) AS n_kept, c.cutoff
    FROM scored s JOIN cut c ON s.category_name = c.category_name AND s.score >= c.cutoff GROUP BY 1, 2, 4""",
)
def p4_cutoffs(spark, sf_dir):
    return cutoffs.cutoffs(_scored(spark, sf_dir)).withColumnRenamed("source_name", "category_name")


# Problem 6


def _review_key(c):
    """A review id as a whole number above zero without leading zeros and final .0; null for any other."""
    return F.nullif(F.regexp_extract(strip(c), r"^0*([1-9][0-9]*)(\.0)?$", 1), F.lit(""))


@llm.query("p6_found")
def p6_found(spark, sf_dir):
    rows = table(spark, sf_dir, "reviews_cleaning2").select(item_key("parent_asin").alias("item"), _review_key("review_id").alias("review"))
    roots = components.hash_to_min(components.star_edges(rows, "item", "review"))
    return roots.where("node <> root").select(F.col("root").alias("first_asin"), F.col("node").alias("parent_asin"))


def _split_rows(spark, sf_dir):
    """(row_id, component): by item where there is one, else by review, else the row alone."""
    rows = table(spark, sf_dir, "reviews_cleaning2").select("row_id", item_key("parent_asin").alias("item"), _review_key("review_id").alias("review"))
    roots = components.hash_to_min(components.star_edges(rows, "item", "review")).withColumnRenamed("node", "item")
    homes = rows.where("item is not null and review is not null").groupBy("review").agg(F.min("item").alias("home"))
    lone = rows.where("item is null and review is not null").join(homes, "review", "left")
    lone = lone.select("row_id", "home", F.concat(F.lit("review "), "review").alias("own"))
    keyed = (
        rows.where("item is not null").select("row_id", F.col("item").alias("home"), F.lit(None).cast("string").alias("own"))
        .unionByName(lone)
        .unionByName(rows.where("item is null and review is null").select("row_id", F.lit(None).cast("string").alias("home"), F.concat(F.lit("row "), "row_id").alias("own")))
    )
    # rows of one item are counted: those of a hot one are not moved
    homes = keyed.where("home is not null").groupBy("home").agg(F.count("*").alias("n"))
    homes = homes.join(roots.withColumnRenamed("item", "home"), "home", "left").select("home", F.coalesce("root", "home").alias("root"), "n")
    placed = hot_join(keyed, cut(homes, "homes"), "home", "n").select("row_id", "root")
    return placed.unionByName(keyed.where("home is null").select("row_id", F.col("own").alias("root")))


@llm.query("p6_splits")
def p6_splits(spark, sf_dir):
    """The split of every row; rows of one component share it."""
    rows = cut(_split_rows(spark, sf_dir), "components")
    targets = [(r["split_name"], r["proportion"]) for r in table(spark, sf_dir, "split_targets").orderBy("split_name").collect()]
    sizes = components.assign_splits(cut(rows.groupBy("root").agg(F.count("*").alias("n")), "sizes"), targets)
    return hot_join(rows, sizes.select("root", "split", "n"), "root", "n").select("row_id", F.col("root").alias("component"), "split")


@llm.query("p6_split_sizes")
def p6_split_sizes(spark, sf_dir):
    split = p6_splits(spark, sf_dir)
    wanted = table(spark, sf_dir, "split_targets").withColumnRenamed("split_name", "split")
    got = split.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("component").alias("n_components"))
    total = got.agg(F.sum("n_rows").alias("total"))
    return wanted.join(got, "split", "left").join(F.broadcast(total)).select("split", "proportion", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_components", F.lit(0)).alias("n_components"), F.round(F.coalesce("n_rows", F.lit(0)) / F.col("total"), 6).alias("share"))


# Problem 7


def _clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "reviews_cleaning2").select("row_id", "sentence_text")
    sets = cut(setjoin.word_sets(rows, "row_id", "sentence_text"), "word-sets")
    links, copied = setjoin.likeness_links(sets)
    return sets, spectral.with_copies(spectral.spectral_clusters(links), copied)


@llm.query("p7_found")
def p7_found(spark, sf_dir):
    _, members = _clusters(spark, sf_dir)
    return members.where("row_id <> root").select(F.col("root").alias("first_row_id"), "row_id")


@llm.query("p7_clusters")
def p7_clusters(spark, sf_dir):
    """Size of each cluster of two rows or more, and its three most typical sentences."""
    sets, members = _clusters(spark, sf_dir)
    best = spectral.typical_members(cut(members, "members"), sets)
    texts = table(spark, sf_dir, "reviews_cleaning2").select("row_id", "sentence_text")
    return best.join(texts, "row_id").select(F.col("root").alias("first_row_id"), "cluster_size", "rank", "row_id", "affinity", "sentence_text")


# Problem 9


def _leaks(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "gold_items")
    return leakage.leaked_spans(docs.select("doc_id", "text"), "doc_id", "text", items.select("item_id", F.col("text").alias("item_text")), "item_id", "item_text")


@llm.query("p9_found")
def p9_found(spark, sf_dir):
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


@llm.query("p9_items")
def p9_items(spark, sf_dir):
    """Each item that leaked: into how many documents, and the longest run."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max(F.col("word_end") - F.col("word_start")).alias("longest_run"))


@llm.query("p9_cleaned")
def p9_cleaned(spark, sf_dir):
    """The documents without leaked spans."""
    spans = cut(_leaks(spark, sf_dir), "leaks")
    return leakage.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text", spans)


# Problem 10


@llm.query("p10_found")
def p10_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.split_sentences(docs, "doc_id", "text").select("doc_id", "char_start", "char_end")


@llm.query("p10_languages")
def p10_languages(spark, sf_dir):
    """Sentences and their mean length per language as labelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lower(strip("lang")).alias("lang"))
    found = sentences.split_sentences(docs, "doc_id", "text")
    return found.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_sentences"), F.round(F.avg(F.col("char_end") - F.col("char_start")), 6).alias("mean_chars")
    )


# Problem 5


def _overlaps(spark, sf_dir):
    """Row-level (train_row_id, eval_row_id, eval_split, likeness, coverage)."""
    rows = table(spark, sf_dir, "seed_42").withColumn("split_key", F.lower(strip("split")))
    side = F.when(F.col("split_key") == "train", 0).when(F.col("split_key").isin("validation", "test"), 1)
    seqs, members = overlap.word_sequences(rows, "row_id", "sentence_text", side)
    pairs = overlap.overlaps(seqs)
    train = members.where("side = 0").select(F.col("seq_id").alias("a"), F.col("row_id").alias("train_row_id"))
    held = members.where("side = 1").select(F.col("seq_id").alias("b"), F.col("row_id").alias("eval_row_id"))
    return pairs.join(train, "a").join(held, "b").select("train_row_id", "eval_row_id", "likeness", "coverage")


@llm.query("p5_found")
def p5_found(spark, sf_dir):
    found = _overlaps(spark, sf_dir)
    return found.select(F.least("train_row_id", "eval_row_id").alias("row_id_a"), F.greatest("train_row_id", "eval_row_id").alias("row_id_b"))


@llm.query("p5_report")
def p5_report(spark, sf_dir):
    """Per held-out split and category: its records, those that overlap train, pairs, and mean coverage."""
    rows = table(spark, sf_dir, "seed_42").select(F.col("row_id").alias("eval_row_id"), F.lower(strip("split")).alias("split"), name_key("category_name").alias("category"))
    held = rows.where(F.col("split").isin("validation", "test"))
    per_row = _overlaps(spark, sf_dir).groupBy("eval_row_id").agg(F.count("*").alias("pairs"), F.max("coverage").alias("coverage"))
    return held.join(per_row, "eval_row_id", "left").groupBy("split", "category").agg(
        F.count("*").alias("n_records"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )


# Problem 3


def _subset(spark, sf_dir):
    rows, targets = table(spark, sf_dir, "reviews_cleaning2"), table(spark, sf_dir, "subset_targets")
    return variety.varied_subset(rows.select("row_id", "sentence_text", "category_name"), targets, "row_id", "sentence_text", "category_name", "category_name", "n_wanted")


@llm.query("p3_subset")
def p3_subset(spark, sf_dir):
    texts = table(spark, sf_dir, "reviews_cleaning2").select("row_id", "sentence_text")
    chosen = _subset(spark, sf_dir).withColumn("gain", F.round("gain", 6))
    return texts.join(F.broadcast(chosen), "row_id").select(F.col("source").alias("category_name"), "place", "row_id", "gain", "sentence_text")


# Problem 8

#: The rank file that packs are measured with; another path may be set in the environment.
TOKENIZER_ENV = "OPINARK_TOKENIZER"


def _tokenizer():
    import os

    import public_tokenizers

    return os.environ.get(TOKENIZER_ENV) or str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def _packs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = [(r["pack_name"], int(r["capacity_tokens"])) for r in table(spark, sf_dir, "pack_sizes").orderBy("pack_name").collect()]
    return packing.pack(docs, "doc_id", "text", sizes, *_tokenizer())


@llm.query("p8_packs")
def p8_packs(spark, sf_dir):
    return packing.pack_rows(_packs(spark, sf_dir))


@llm.query("p8_fill")
def p8_fill(spark, sf_dir):
    """Packs of each size, the least number that could do, and the share of room used."""
    packs = _packs(spark, sf_dir)
    return packs.groupBy("pack_name", "capacity").agg(
        F.count("*").alias("n_packs"), F.ceil(F.sum("load") / F.first("capacity")).alias("n_least"), F.sum("load").alias("n_tokens"), F.round(F.sum("load") / F.sum("capacity"), 6).alias("fill")
    )
