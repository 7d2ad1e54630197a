"""Schemas of the pipeline's tables, with validation and conforming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SIMPLE = {"string": T.StringType, "double": T.DoubleType, "float": T.FloatType, "bigint": T.LongType, "int": T.IntegerType, "boolean": T.BooleanType}


def _parts(text: str) -> list[str]:
    """Split at commas outside angle brackets."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]


def _type(text: str) -> T.DataType:
    """A type from its short form; needs no session, unlike Spark's own parser."""
    text = text.strip()
    kind, _, inner = text.partition("<")
    if not inner:
        return _SIMPLE[text]()
    parts = _parts(inner[:-1])
    if kind == "array":
        return T.ArrayType(_type(inner[:-1]))
    if kind == "map":
        return T.MapType(_type(parts[0]), _type(parts[1]))
    return T.StructType([T.StructField(n.strip(), _type(t)) for n, _, t in (p.partition(":") for p in parts)])


def _struct(columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _type(t)) for n, _, t in (p.strip().partition(" ") for p in _parts(columns))])


IMAGES = "array<struct<small_image_url:string,medium_image_url:string,large_image_url:string,attachment_type:string>>"
REVIEWS = _struct(f"rating double, title string, text string, images {IMAGES}, asin string, parent_asin string, user_id string, timestamp bigint, helpful_vote bigint, verified_purchase boolean")
META = _struct(
    "main_category string, title string, average_rating double, rating_number bigint, features array<string>, description array<string>, price double, "
    "images array<map<string,string>>, videos array<map<string,string>>, store string, details string, parent_asin string, bought_together double, subtitle string, author string, categories array<string>"
)
SENTENCES = _struct("parent_asin string, review_id string, sentence_id bigint, sentence_text string, rating double")
AUDIT = _struct(
    "parent_asin string, review_id string, rating double, orig_sentence_id bigint, original_sentence_text string, normalized_text string, final_text string, "
    "keep boolean, primary_reason string, generic_token_hits int, domain_noise_hits int, char_count int, token_count int, flag_too_short boolean, flag_no_noun_or_np boolean, "
    "flag_adj_only boolean, flag_social boolean, flag_pronoun_target_only boolean, flag_all_targets_generic_or_noise boolean, flag_no_dependency_pattern boolean, matched_patterns array<string>"
)
TRIPLETS = "array<struct<aspect:string,opinion:string,sentiment:int>>"
LABELED = _struct(f"parent_asin string, sentence_id string, sentence_text string, rating double, triplets {TRIPLETS}, category_name string")
ATE_HIGH = _struct("parent_asin string, sentence_id string, sentence_text string, category_name string, rating double, gate_confidence double, aspects array<string>, confidences array<double>")
ATE_LOW = _struct("parent_asin string, sentence_id string, sentence_text string, rating double, gate_confidence double")
ATE_ALL = _struct("parent_asin string, sentence_id string, sentence_text string, category_name string, rating double, gate_confidence double, aspects array<string>, confidences array<double>, confidence_bucket string")
ASC_HIGH = _struct("parent_asin string, sentence_id string, sentence_text string, category_name string, rating double, gate_confidence double, aspects array<string>, sentiments array<array<float>>")
ASC_LOW = _struct("parent_asin string, sentence_id string, sentence_text string, rating double, category_name string, aspects array<string>")
TOKENS = "array<struct<i:int,text:string,lemma:string,tag:string,pos:string,dep:string,head:int>>"


def validate(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """df itself, or an error that names the required columns it lacks."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of schema, in order and type; absent ones are null, unreadable values too."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        same = f.name in have and df.schema[f.name].dataType == f.dataType
        simple = isinstance(f.dataType, T.AtomicType) and (f.name not in have or isinstance(df.schema[f.name].dataType, T.AtomicType))
        out.append((c if same else c.try_cast(f.dataType) if simple else c.cast(f.dataType)).alias(f.name))
    return df.select(*out)


def keep_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that df has, in the named order."""
    return df.select(*(c for c in names if c in df.columns))
