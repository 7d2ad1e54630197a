import random

import pytest

from opinark.llm import sentences


def cut(text):
    return [text[a:b] for a, b in sentences.sentences(text)]


CASES = [
    ("It broke. Twice! Why?", ["It broke.", "Twice!", "Why?"]),
    ("Dr. Lane paid $3.50 for it, i.e. less than No. 5 on the list. Good.", ["Dr. Lane paid $3.50 for it, i.e. less than No. 5 on the list.", "Good."]),
    ("We waited until 6 p.m. The file a_v2.3.pdf came.", ["We waited until 6 p.m.", "The file a_v2.3.pdf came."]),
    ('"It broke. Twice." was all he said. Then silence.', ['"It broke. Twice." was all he said.', "Then silence."]),
    ("(It was not cheap!) My father paid.", ["(It was not cheap!)", "My father paid."]),
    ("The lid (finally!) stays put.", ["The lid (finally!) stays put."]),
    ("Nice one! 👍 Next one.", ["Nice one! 👍", "Next one."]),
    ("It is fine.See fig. 3 on p. 4 of it.", ["It is fine.", "See fig. 3 on p. 4 of it."]),
    ("Pros:\n- light weight\n- long life\n\nIt works.", ["Pros:", "- light weight", "- long life", "It works."]),
    ("1. First point\n2. Second point", ["1. First point", "2. Second point"]),
    ("This runs over\nthe line end. Next.", ["This runs over\nthe line end.", "Next."]),
    ("One.<br/>Two.<br /><br />Three", ["One.", "Two.", "Three"]),
    ("Am 11. März kam es, d. h. spät. Gut.", ["Am 11. März kam es, d. h. spät.", "Gut."]),
    ("„Ist das gut?“, fragte sie. Ja.", ["„Ist das gut?“, fragte sie.", "Ja."]),
    ("Le 5 janv. dernier, M. Lane est venu. « Bien », dit-il.", ["Le 5 janv. dernier, M. Lane est venu.", "« Bien », dit-il."]),
    ("¿Por qué? En EE. UU. fabrican la funda.", ["¿Por qué?", "En EE. UU. fabrican la funda."]),
    ("很好。“真的吗？”妈妈问道。他说：“好。也不错。”坏了！", ["很好。", "“真的吗？”妈妈问道。", "他说：“好。也不错。”", "坏了！"]),
    ("「静か。便利。」と彼は言いました。価格は18.6ドルでした。（別売りです。）", ["「静か。便利。」と彼は言いました。", "価格は18.6ドルでした。", "（別売りです。）"]),
    ("यह ठीक है। क्या यह अच्छा है? डॉ. राम ने कहा।", ["यह ठीक है।", "क्या यह अच्छा है?", "डॉ. राम ने कहा।"]),
    ("هل هذا جيد؟ قال د. علي نعم.", ["هل هذا جيد؟", "قال د. علي نعم."]),
    ("ดีมากครับ ราคา 18.5 บาท ถือว่าคุ้มค่ะ", ["ดีมากครับ", "ราคา 18.5 บาท ถือว่าคุ้มค่ะ"]),
    ("it scored 4.5 with us! who needs it. we waited until 6 p.m. there it was.", ["it scored 4.5 with us!", "who needs it.", "we waited until 6 p.m.", "there it was."]),
    ("It works. INC. AND LTD. LABELS ASIDE, IT IS FINE. Good.", ["It works.", "INC. AND LTD. LABELS ASIDE, IT IS FINE.", "Good."]),
    ("", []),
    (" \n\t<br/> ", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_cases(text, want):
    assert cut(text) == want


def test_offsets_cover_all_but_white_space_and_tags():
    rng = random.Random(12)
    alphabet = list("abAB .!?\n\"()“”。！「」12,;:•-👍") + ["<br/>", "Dr. ", "ครับ "]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        spans = sentences.sentences(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        covered = set().union(*(range(a, b) for a, b in spans)) if spans else set()
        masked = sentences._mask(text)
        assert all(k in covered for k, c in enumerate(masked) if not c.isspace())
        assert all(not masked[a].isspace() and not masked[b - 1].isspace() for a, b in spans)


MORE_CASES = [
    ("We sell it. Acme Ltd.\nboxes are fine.", ["We sell it.", "Acme Ltd.\nboxes are fine."]),
    ("we left at 6 p.m.\nthere it was.", ["we left at 6 p.m.", "there it was."]),
    ("IT MEASURES 3.1 X 1 IN. AND WEIGHS 2 LBS. WITHOUT THE LID. GOOD.", ["IT MEASURES 3.1 X 1 IN. AND WEIGHS 2 LBS. WITHOUT THE LID.", "GOOD."]),
    ('"it broke. twice." is what he told us. then silence.', ['"it broke. twice." is what he told us.', "then silence."]),
    ('"it broke. twice." was it true? yes.', ['"it broke. twice."', "was it true?", "yes."]),
    ("Es kam am\n11. März an. Gut.", ["Es kam am\n11. März an.", "Gut."]),
    ("1. Lid\n2. Box\n3. Am\n4. Ende", ["1. Lid", "2. Box", "3. Am", "4. Ende"]),
    ("1. Lid\n  a) red\n  b) blue\n2. Box", ["1. Lid", "a) red", "b) blue", "2. Box"]),
    ("“好。”老师写道。“好。”我喜欢，他问过。", ["“好。”老师写道。", "“好。”", "我喜欢，他问过。"]),
]


@pytest.mark.parametrize("text, want", MORE_CASES)
def test_abbreviations_quotations_and_list_levels(text, want):
    assert cut(text) == want


@pytest.mark.parametrize("unit", ["Mr. Lane, ", "5 in. a, ", "a.b.", "(a.) b ", '"A." b ', "a... b ", "a...b", "a b c d\n", "1. a\n", "A B C D E\n", "👍)", "(]\"[)", "(", '(("«', "“好。”他，"])
def test_time_grows_with_the_text(unit):
    import time

    began = time.process_time()
    sentences.sentences(unit * 30_000)
    assert time.process_time() - began < 8


def test_long_text_is_linear():
    assert len(sentences.sentences("It works well. " * 20_000)) == 20_000
    assert len(sentences.sentences("x" * 500_000)) == 1
    sentences.sentences("(" * 5_000 + '"' * 5_000)


def test_frame(spark):
    df = spark.createDataFrame([(1, "Go on. We go."), (2, None), (3, ""), (1, "Go on. We go.")], "doc_id long, text string").selectExpr("*", "7 AS char_start", "8 AS d", "9 AS t")
    got = sorted((r.doc_id, r.sentence_no, r.char_start, r.char_end) for r in sentences.split_sentences(df, "doc_id", "text").collect())
    assert got == sorted([(1, 1, 0, 6), (1, 2, 7, 13)] * 2)
    assert sentences.split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_tags_of_any_length_are_white_space():
    tag = '<a href="https://example.org/' + "path. " * 200 + '">'
    assert cut(f"It broke. {tag}Twice!</a> Why?") == ["It broke.", "Twice!", "Why?"]
    assert cut(f"It came in {tag}two</a> parts.") == [f"It came in {tag}two</a> parts."]
