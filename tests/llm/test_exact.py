"""Texts whose pieces, lines and words only a look at their bytes tells apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandframe.llm import compression, langid, qualityrules, textkernel, tokencount

from .test_models import _brute_base


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def thue_morse(a, b, size):
    """The two words of this size whose polynomial hashes are alike modulo 2**64 under every odd base, from 1,024 on."""
    signs = "".join(ab[bin(i).count("1") & 1] for i in range(size) for ab in [(a, b)])
    return signs, signs.translate({ord(a): b, ord(b): a})


SIZES = (512, 1024, 2048, 4096)


def test_token_counts(spark, tokenizer):
    texts = [t for x, y in ("er", "17", "th", "=-", "ab") for size in SIZES for t in thue_morse(x, y, size)]
    texts += [" ".join(texts[i : i + 2]) for i in range(0, len(texts), 2)] + ["!".join(texts)]
    theirs = Tokenizer.from_file(tokenizer)
    want = [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]
    one = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(one, tokenizer).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len({tuple(want[i : i + 2]) for i in range(0, 40, 2)}) > 1


def test_quality_counts(spark):
    texts = []
    for x, y in ("er", "17", "é-"):
        for size in SIZES:
            a, b = thue_morse(x, y, size)
            texts += [f"{a}\n{b}", f"{a}\n{b}\n{a}", f"w x {a} y z. w x {b} y z", f"v {a} w {b} x {a} y\n" * 2, f"p q {a} r s p q {b} r s p q {a} r s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in qualityrules.judge(docs, None).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _brute_base(texts[r["doc_id"]])


def test_lying_hashes():
    """Numbers of spans are exact even if all hashes are the same; so are repeated runs."""
    words = [b"a", b"b", b"a", b"", b"ab", b"ba", b"b", b"a", b"b", b"a"]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for hashes in (np.zeros(len(words), dtype=np.uint64), np.array([hash(w) & 0xFFFF for w in words], dtype=np.uint64)):
        ids = textkernel.exact_ids(data, starts, ends, hashes)
        assert [[x == y for y in words] for x in words] == [[x == y for y in ids] for x in ids]
    rows = np.array([0, 0, 0, 0, 0, 0, 1, 1, 1, 1])
    for size in (1, 2, 3):
        first, twice = textkernel.repeated(ids, rows, size)
        runs = [(rows[i], *ids[i : i + size].tolist()) for i in range(len(ids) - size + 1) if rows[i] == rows[i + size - 1]]
        assert [runs.count(x) > 1 for x in runs] == twice.tolist() and len(runs) == len(first)


def test_bytes_that_are_not_utf8(spark, tokenizer):
    """Such bytes count as U+FFFD for tokens and languages; classifiers see them as they are. Nothing fails."""
    made = spark.createDataFrame([(1, "61FF62C328"), (2, "C3A9"), (3, "FF"), (4, "F09F98")], "doc_id long, h string").select("doc_id", F.expr("cast(unhex(h) AS string)").alias("text"))
    theirs = Tokenizer.from_file(tokenizer)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokencount.token_counts(made, tokenizer).collect()}
    raw = {1: b"a\xffb\xc3(", 2: b"\xc3\xa9", 3: b"\xff", 4: b"\xf0\x9f\x98"}
    assert got == {i: (len(b), len(theirs.encode(b.decode("utf-8", "replace"), add_special_tokens=False).ids)) for i, b in raw.items()}
    assert langid.identify(made, None).count() == 4
    assert compression.score(made, None, "p").count() == 4
    assert qualityrules.judge(made, None).count() == 4


def test_toxicity_without_enough_text_to_train_learns_nothing(spark):
    """The trainer's refusal is a warning and every score 0.5; nothing else stands in for its dictionary."""
    docs = spark.createDataFrame([(i, "both say the same") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="isn't learned"):
        assert compression.learn_toxicity(docs, labels) is None
    with pytest.raises(compression.Untrainable):
        compression.trained([b"too", b"few"], 4096)
    assert compression.trained([b"some words %d of text that a trainer takes" % i for i in range(2000)], 4096)[:4] == b"\x37\xa4\x30\xec"


def test_many_languages_keep_the_masks_small(spark):
    """Hundreds of language values: the array stays in its bound, and languages are still told apart."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda i: " ".join(letters[i % 26] + letters[i // 26] + letters[(7 * i + k) % 26] for k in range(3))
    rows = [(i, f"l{i:03d}", text(i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    held = docs.select(F.col("doc_id").alias("number"), F.col("doc_id").alias("code"))
    small = langid.Filter.build([r[1] for r in rows], held, 0, most_bytes=1 << 16)
    assert small.masks.nbytes <= 1 << 16 and small.masks.shape[1] == 5
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.learn(docs.select("lang", "text"))).collect()}
    assert sum(got[i] == lang for i, lang, _ in rows) > 285
