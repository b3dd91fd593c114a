"""Classifiers, language ID, token counts, URL filters and mixing."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandframe.llm import compression, labelled as samples, langid, mixing, qualityrules, tokencount, urlfilter

DOCS = "doc_id long, text string, lang string, source string, score string"


def _word(rng, parts):
    return "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents in two languages; bad ones have symbols on words or repeat them, toxic ones hold insults."""
    rng = random.Random(2)
    parts = {"aa": ["th", "er", "on", "an", "re", "he"], "bb": ["ue", "ci", "os", "ña", "llo", "mente"]}
    docs, labels = [], []
    for i in range(700):
        lang = "aa" if i % 3 else "bb"
        w = [_word(rng, parts[lang]) for _ in range(rng.randint(40, 200))]
        quality, toxic = int(i % 5 != 0), int(i % 4 == 1)
        if not quality:
            w = [x + "%%%" for x in w] if i % 2 else [x for x in w[:15] for _ in range(9)]
        if toxic:
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(["zquiblo", "worfnak", "zquibs"])
        docs.append((i, " ".join(w), lang, f"s{i % 4}", "own"))
        labels.append((i, quality, toxic))
    docs += [(9001, None, None, None, "own"), (9002, "", "aa", "s0", "own"), (9003, "12 34", "bb", "s0", "own"), docs[5], (9004, "the er " * 20000, "aa", "s1", "own"), (None, "er on", "aa", "s1", "own")]
    return (
        spark.createDataFrame(docs, DOCS).repartition(4),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {x[0]: x for x in labels},
    )


@pytest.mark.parametrize(("learn", "column"), [(compression.learn_quality, 1), (compression.learn_toxicity, 2)])
def test_compression_classifiers(labelled, learn, column):
    docs, labels, truth = labelled
    got = (
        compression.score(docs, learn(docs, labels), "p")
        .select("doc_id", "p", "score", (langid.fold(F.col("doc_id"), 5) == 0).alias("held"))
        .collect()
    )
    assert len(got) == 706 and all(0 <= r["p"] <= 1 for r in got) and {r["score"] for r in got} == {"own"}
    held = [((r["p"] >= 0.5) == bool(truth[r["doc_id"]][column])) for r in got if r["held"] and r["doc_id"] in truth]
    assert len(held) > 80 and sum(held) / len(held) >= 0.9


def test_toxicity_learns_from_words_of_few_texts(spark):
    """Each insult is in about an eighth of the toxic texts and some are in ordinary ones."""
    rng = random.Random(5)
    words = [_word(rng, ["th", "er", "on", "an", "re", "he", "st", "in"]) for _ in range(900)]
    insults = ["".join(rng.choice("bcdfgjkpqvwxz") + rng.choice("aiou") for _ in range(5)) for _ in range(40)]
    docs, labels = [], []
    for i in range(500):
        w = [rng.choice(words) for _ in range(120)]
        for _ in range(5 if i % 2 else i % 32 == 0):
            w[rng.randrange(len(w))] = rng.choice(insults)
        docs.append((i, " ".join(w)))
        labels.append((i, i % 2))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = compression.score(docs, compression.learn_toxicity(docs, labels), "p").filter(langid.fold(F.col("doc_id"), 5) == 0).collect()
    right = [(r["p"] >= 0.5) == bool(r["doc_id"] % 2) for r in got]
    assert len(right) > 80 and sum(right) / len(right) >= 0.85


@pytest.mark.parametrize(("learn", "target"), [(compression.learn_quality, 1), (compression.learn_toxicity, 2)])
def test_scores_are_differences_of_compressed_sizes(labelled, learn, target):
    """Features by hand: every window of the whole text compressed on its own under either dictionary."""
    import zstandard

    docs, labels, _ = labelled
    model = learn(docs, labels)
    one, other = (model.bad, model.good) if target == 1 else (model.ordinary, model.toxic)

    def size(s, data):
        d = zstandard.ZstdCompressionDict(s.content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(
            zstandard.ZstdCompressor(level=s.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data)
        )

    texts = [r["text"].encode() for r in docs.limit(30).collect() if r["text"]] + [b"", b"a", "é ".encode() * 3000]
    for t, f in zip(texts, model.features(texts), strict=True):
        low = t if target == 1 else t.lower()
        parts = compression.windows(low, model.window)
        assert b"".join(parts) == low and all(len(x) <= model.window for x in parts)
        saved = [size(one, x) - size(other, x) for x in parts]
        if target == 1:
            assert f.tolist() == pytest.approx([sum(saved) / (len(t) + 1)])
        else:
            assert f[-2:].tolist() == pytest.approx([sum(saved) / len(saved), min(16, max(0, max(saved)))])
            assert f[1] == pytest.approx(sum(x >= 1 for x in saved) / len(saved))


def test_a_label_given_twice_counts_as_its_larger_value(spark):
    docs = spark.createDataFrame([(i, "text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i in range(40) for q in (0, 1)], "doc_id long, quality int")
    assert {r["y"] for r in samples.sample(docs, labels, "quality").collect()} == {1}


def test_sample_is_full_where_labels_lack_fitting_documents(spark):
    docs = spark.createDataFrame(
        [(i, None if i % 5 == 0 else "" if i % 5 == 1 else "x" * 50 if i % 5 == 2 else "text") for i in range(400)],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, quality int")
    got = samples.sample(docs, labels, "quality", per_class=30, max_chars=40).collect()
    assert Counter(r["y"] for r in got) == {0: 30, 1: 30} and {r["text"] for r in got} == {"text"}


def test_passages_come_from_every_text():
    texts = [f"{i:04d}".encode() * 150 for i in range(1000)]
    held = compression._passages(texts, 65536)
    assert len(held) <= 65536 and all(t[:4] * 3 in held or t[1:5] * 3 in held or t[2:6] * 3 in held or t[3:7] * 3 in held for t in texts)


def test_classifiers_without_labels(spark, labelled):
    docs, labels, _ = labelled
    none = labels.filter(F.lit(False))
    assert compression.learn_quality(docs, none) is None and compression.learn_toxicity(docs, labels.filter("toxic = 0")) is None
    assert {r["p"] for r in compression.score(docs, None, "p").collect()} == {0.5}
    assert compression.keep_good(docs, none).count() == docs.count()
    assert compression.score(docs.filter(F.lit(False)), None).collect() == []
    assert qualityrules.learn(docs, none) is None


def _brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x, n in Counter(g).items() if n > 1}
    hit = {i + k for i, x in enumerate(g) if x in twice for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_rules(spark, labelled):
    docs, labels, truth = labelled
    rng = random.Random(4)
    more = ["a b c d e\na b c d e\n a b c d e\n\n\n", "x " * 40, "é ñ | # \x0b\x0c ü\r\n<>&", "\n".join(rng.choice(["one two", "three", ""]) for _ in range(200)), " ".join(rng.choice("abc") for _ in range(3000)), "\x1c\x85\xa0 z"]
    extra = spark.createDataFrame([(8000 + i, t, None, None, "own") for i, t in enumerate(more)], DOCS)
    every = docs.unionByName(extra)
    got = qualityrules.judge(every, qualityrules.learn(docs, labels)).collect()
    texts = {r["doc_id"]: r["text"] for r in every.collect()}
    for r in got:
        n = _brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r["kept"] and r["base_failed"])
    right = [r["kept"] == bool(truth[r["doc_id"]][1]) for r in got if r["doc_id"] in truth]
    assert sum(right) / len(right) > 0.97
    assert all(r["kept"] != r["base_failed"] for r in qualityrules.judge(every, None).collect())
    assert qualityrules.judge(every.filter(F.lit(False)), None).collect() == []


def test_features_are_words_pairs_and_character_trigrams():
    import numpy as np
    import pyarrow as pa

    texts = ["ab cd ab", "", "é中🙂x", "ab", "a b c d e é"]
    data, offsets = qualityrules.buffers(pa.array([t.encode() for t in texts], type=pa.binary()))
    found = qualityrules.words(data, offsets, qualityrules.NONSPACE)
    w, pairs, chars = qualityrules._features(data, offsets, found, 14)
    for (slots, first), of in ((w, lambda t: t.split()), (pairs, lambda t: list(zip(t.split(), t.split()[1:], strict=False))), (chars, lambda t: [t[i : i + 3] for i in range(len(t) - 2)])):
        slot = {}
        for i, t in enumerate(texts):
            own = of(t)
            assert first[i + 1] - first[i] == len(own)
            for x, s in zip(own, slots[first[i] : first[i + 1]].tolist(), strict=True):
                assert slot.setdefault(x, s) == s
        assert len(set(slot.values())) == len(slot) and np.all(slots < 1 << 14)


def test_language_id(spark, labelled):
    docs, _, _ = labelled
    model = langid.learn(docs.filter(langid.fold(F.col("doc_id"), 4) != 2).select("lang", "text"))
    assert model.langs == ["aa", "bb"]
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    by = {r["doc_id"]: r for r in got}
    assert by[9001]["lang_pred"] == by[9002]["lang_pred"] == by[9003]["lang_pred"] == "und" and by[9001]["score"] == 0
    own = [r["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 9000]
    assert sum(own) / len(own) > 0.99 and all(0 <= r["score"] <= 1 for r in got)
    assert langid.learn(docs.filter("lang IS NULL").select("lang", "text")) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_few_documents_teach_every_language(spark):
    rows = spark.createDataFrame(
        [
            ("en", "the cat sat on the mat"),
            ("en", "where is the house"),
            ("es", "el gato en la casa"),
            ("es", "donde esta el perro"),
            ("xx", "the cat sat on the mat"),
        ],
        "lang string, text string",
    )
    model = langid.learn(rows)
    assert model.langs == ["en", "es", "xx"]
    docs = spark.createDataFrame([(1, "the house"), (2, "el perro en casa"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"], got[3]["lang_pred"]) == ("en", "es", "und") and got[1]["score"] > 0.5
    assert langid.identify(docs.filter(F.lit(False)), model).collect() == []
    assert langid.learn(spark.createDataFrame([("en", "12 3"), ("es", None)], "lang string, text string")) is None


def test_language_popcounts_against_sets(spark, labelled):
    """The filter's counts are those of exact sets of trigrams but for the false positives that it corrects."""
    docs, _, _ = labelled
    rows = docs.select("lang", "text").filter("lang IS NOT NULL")
    model = langid.learn(rows)
    counts = langid.gram_counts(rows).collect()
    total = Counter()
    for r in counts:
        total[r["lang"]] += r["n"]
    p = {(r["lang"], r["code"]): r["n"] / total[r["lang"]] for r in counts}
    best = {}
    for (_, c), x in p.items():
        best[c] = max(best.get(c, 0), x)
    held = {k for k, x in p.items() if x >= 5e-6 and x >= 0.2 * best[k[1]]}
    for t in [r["text"] for r in docs.limit(40).collect() if r["text"]]:
        codes, _ = langid.trigrams([t.encode()])
        if not len(codes):
            continue
        n = [sum((x, c) in held for c in codes.tolist()) for x in model.langs]
        name, score = (x[0] for x in model.decide([t.encode()]))
        if sorted(n)[-1] > 1.2 * sorted(n)[-2]:
            assert name == model.langs[n.index(max(n))] and abs(score - max(n) / sum(n)) < 0.05


def test_bloom_filter_holds_all_languages_of_a_gram(spark):
    import numpy as np

    codes = np.arange(1000, dtype=np.int64) * 7919
    held = spark.createDataFrame([(i % 70, int(c)) for i, c in enumerate(codes)], "number int, code long")
    made = langid.Filter.build([f"l{i:02}" for i in range(70)], held, 0)
    held = None
    for slot in langid._slots(codes, made.log2, made.hashes):
        held = made.masks[slot] if held is None else held & made.masks[slot]
    assert all(int(held[i, (i % 70) // 64]) >> (i % 70 % 64) & 1 for i in range(1000))


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts(spark, tokenizer):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "'", "'ll", "1", "23", "!", "%%", "é", "ß", "中文", "\x1c", "\x85", "the", " the", "<|endoftext|>", "🙂", "ing", "\r\n", "\u3000", "½", "'S", "\u200b"]
    texts = (
        ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + [
            "a" * 20000,
            "ab" * 4000,
            " " * 3000,
            "\n" * 999 + "x",
            "",
            "<|endoftext|>",
            "word " * 20000,
        ]
    )
    theirs = Tokenizer.from_file(tokenizer)
    want = {i: len(e.ids) for i, e in enumerate(theirs.encode_batch(texts, add_special_tokens=False))}
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in tokencount.token_counts(docs, tokenizer).collect()}
    assert (got[-1]["n_tokens"], got[-1]["n_bytes"], got[-1]["over_limit"]) == (0, 0, False)
    assert {i: got[i]["n_tokens"] for i in want} == want
    assert all(got[i]["n_bytes"] == len(t.encode()) and got[i]["over_limit"] == (want[i] > 1024) for i, t in enumerate(texts))
    assert tokencount.token_counts(docs.filter(F.lit(False)), tokenizer).collect() == []


def test_chunk_maps_compose(tokenizer):
    """Pieces of many chunks: maps from likely start states, with and without the true one, give what one run gives."""
    import numpy as np

    rng = random.Random(12)
    t = tokencount.Tokenizer(open(tokenizer, "rb").read())
    for text in ("a" * 1200, "".join(rng.choice("abehilnorst") for _ in range(1500)), "ab" * 400 + "the" * 200, "".join(rng.choice("aé中") for _ in range(600))):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        whole = t.counter.run(data, np.array([0]), np.array([len(data)]), np.array([0]))
        end, n = t.counter._composed(data, 0, len(data), 0)
        assert (end, n) == (int(whole[0][0]), int(whole[1][0])) == (end, len(t.counter.merged(text.encode())))


def test_full_stores_start_anew(tokenizer):
    big, small = (tokencount.Tokenizer(open(tokenizer, "rb").read()) for _ in range(2))
    small.counter.limit = small.counter.piece_limit = 50
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh e") for _ in range(200)).encode() for _ in range(60)]
    assert all((big.counts([t]) == small.counts([t])).all() for t in texts) and small.counter.table.held < 2000


def test_urls(spark):
    long = "https://a.org/" + "/".join(f"p{i}" for i in range(30000)) + "?" + "&".join(f"k{i}=1" for i in range(3000))
    urls = [
        (long, "a.org", long[len("https://a.org") :].split("?")[0], None, None),
        ("http://A.Net", "a.net", "", None, None), ("http://a.net/x", "a.net", "/x", "net/", "block"), ("https://m.Example.net/en/1?x#y", "m.example.net", "/en/1", "example.net/en/", "allow"), ("https://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("ftp://example.com/de/#q", "example.com", "/de/", "example.com/de/", "block"), ("x://w.org/fr/a/", "w.org", "/fr/a/", "org/fr/", "allow"), ("nothing", "", "", None, None), (None, "", "", None, None), ("http://?q://r", "", "", None, None), ("", "", "", None, None), ("http://a.com#x?y/z", "a.com", "", None, None),
    ]
    pages = spark.createDataFrame([(i, u[0], "own") for i, u in enumerate(urls)] + [(0, urls[0][0], "own")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urlfilter.judge(pages, labels).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        _, host, path, rule, verdict = urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_mined_rules_block_what_labels_show(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        host = f"{rng.choice(['w', 'x', 'y'])}.{'free-bets' if bad else rng.choice(['news', 'blog'])}.com"
        rows.append((i, f"https://{host}/{rng.choice(['en', 'de'])}/{i}", int(not bad)))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2 == 0], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, labels, rules=[]).collect()}
    assert all((got[i]["verdict"] == "block") == (q == 0) for i, _, q in rows)
    assert urlfilter.judge(pages.filter(F.lit(False)), labels).collect() == []
    spread = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, labels, rules=[], broadcast_rules=0).collect()}
    assert spread == {i: r["verdict"] for i, r in got.items()}


def test_mined_rules_against_brute_force(spark):
    """Planted: two tokens together tell bad URLs, neither alone does; labels are wrong now and then; tokens hold line breaks."""
    from itertools import combinations

    rng = random.Random(15)
    rows = []
    for i in range(1500):
        shop, path = rng.choice(["shop", "news", "blog\nx"]), rng.choice(["win", "read", "x\nwin"])
        bad = (shop == "shop" and path == "win") != (rng.random() < 0.05)
        rows.append((i, f"https://{shop}.{rng.choice(['aa', 'bb'])}.com/{path}/{rng.randint(1, 9)}", int(bad), shop == "shop" and path == "win"))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, _, b, _ in rows if i % 3], "doc_id long, quality int, toxic int")
    t = [(frozenset(r["items"]), r["bad"]) for r in urlfilter.transactions_of(pages, labels).collect()]
    n, share = len(t), sum(b for _, b in t) / len(t)
    have, bad = Counter(), Counter()
    for items, b in t:
        for k in range(1, len(items) + 1):
            for x in combinations(sorted(items), k):
                have[x] += 1
                bad[x] += b
    want = {x: bad[x] / have[x] for x in bad if bad[x] >= max(0.001 * n, 20) and bad[x] / have[x] >= 0.6 and bad[x] / have[x] / share >= 1.5}
    mined = urlfilter.mine(urlfilter.transactions_of(pages, labels)).collect()
    # Tokens that the same URLs hold are one class in the mined rules, and tokens that all hold are in none.
    holders = {x: frozenset(i for i, (items, _) in enumerate(t) if x in items) for x in {x for items, _ in t for x in items}}
    alike = {x: frozenset(y for y in holders if holders[y] == holders[x]) for x in holders if len(holders[x]) < n}
    reduced = {frozenset(alike[y] for y in x if y in alike): c for x, c in want.items()}
    assert any(len(c) > 1 for x in reduced for c in x) and len(alike) < len(holders)
    assert {frozenset(map(frozenset, r["members"])): pytest.approx(r["confidence"]) for r in mined} == reduced and len(mined) == len(reduced)
    assert all(r["key"] in r["members"] and r["antecedent"] == sorted(min(c) for c in r["members"]) for r in mined)
    verdicts = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, labels, rules=[]).collect()}
    tokens = {
        r["page_id"]: set(r["t"]) for r in urlfilter.parsed(pages).select(
            "page_id",
            urlfilter.tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("t"),
        ).collect()
    }
    assert verdicts == {i: "block" if any(set(x) <= tokens[i] for x in want) else "allow" for i in tokens}
    assert all((verdicts[i] == "block") == planted for i, _, _, planted in rows)
    figures = urlfilter.report(pages, labels)
    assert figures["kept"] == len(reduced) and figures["urls"] == n and figures["bad_share"] == pytest.approx(share)


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), s, "own") for i, s in enumerate(["big"] * 900 + ["mid"] * 200 + ["low"] * 40 + [None] * 20)]
    rows += [(5002, "w " * 300000, "big", "own"), (5000, "", "void", "own"), (5001, None, "void", "own"), rows[0], rows[0]]
    docs = (
        spark.createDataFrame(rows, "doc_id long, text string, source string, place string")
        .repartition(4)
        .withColumns({c: F.lit("own") for c in ("_s", "_b", "_e", "places", "copies")})
    )
    got = mixing.mixture(docs, entropy=0.95, max_repeat=3.0, blocks=64).collect()
    have, want, seen = Counter(), Counter(), defaultdict(Counter)
    for r in rows:
        have[r[2]] += len((r[1] or "").split())
    for r in got:
        want[r["source"]] += r["n_tokens"]
        seen[r["source"]][r["doc_id"]] += 1
    assert {r[0] for r in rows} == {r["doc_id"] for r in got}
    assert max(want[s] / have[s] for s in have if have[s]) <= 3.0 + 1e-6
    assert want["big"] == have["big"] and all(n == 1 for i, n in seen["big"].items() if i) and seen["big"][0] == 3 and seen["void"] == Counter({5000: 1, 5001: 1})
    # Repeats follow (largest / own) ** (1 - exponent), within a block of each source.
    import math

    exponent = 1 - math.log(3.0) / math.log(have["big"] / have[None])
    for s in ("mid", "low", None):
        goal = (have["big"] / have[s]) ** (1 - exponent)
        assert goal - 0.25 <= want[s] / have[s] <= goal + 1e-3
    again = mixing.mixture(docs.repartition(7), entropy=0.95, max_repeat=3.0, blocks=64).collect()
    assert Counter((r["doc_id"], r["epoch"], r["place"]) for r in again) == Counter((r["doc_id"], r["epoch"], r["place"]) for r in got)
    spread = mixing.mixture(docs, entropy=0.95, max_repeat=3.0, blocks=64, broadcast_places=0).collect()
    assert Counter((r["doc_id"], r["epoch"], r["place"]) for r in spread) == Counter((r["doc_id"], r["epoch"], r["place"]) for r in got)


def test_mixing_leaves_even_sources_alone(spark):
    docs = spark.createDataFrame([(i, "a b", f"s{i % 4}") for i in range(80)], "doc_id long, text string, source string")
    assert mixing.mixture(docs).count() == 80 and mixing.mixture(docs.filter(F.lit(False))).count() == 0
    half = mixing.mixture(docs, budget=80, blocks=16)
    assert 0 < half.count() <= 40


def test_mixing_meets_a_target_entropy(spark):
    import math

    rows = [(i, "a b c", "x") for i in range(600)] + [(1000 + i, "a b c", "y") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = Counter(r["source"] for r in mixing.mixture(docs, entropy=0.9, max_repeat=10.0).collect())
    p = n["y"] / (n["x"] + n["y"])
    h = -(p * math.log(p) + (1 - p) * math.log(1 - p)) / math.log(2)
    assert abs(h - 0.9) < 0.02 and n["x"] == 600
