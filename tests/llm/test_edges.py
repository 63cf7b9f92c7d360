"""All ten operators on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables; and cases that broke earlier forms."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaystone.llm import byte_bpe, chat, common, decontaminate, near_dups, quality, repeats, secrets, shards, token_counts, toxicity

rng = random.Random(8)
VOCAB = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
prose = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
LONG = prose(60_000)
ROWS = [(1, None), (2, ""), (3, prose(50)), (3, prose(50)), (4, "same text here"), (5, "same text here"), (5, "same text here"), (6, LONG), (None, prose(30)), (7, "\n\t "), (8, "é" * 3000 + " 😀")]
CLASHES = ("size", "__key", "__id", "__row", "prefix", "before", "marks", "shard", "SLOT", "spans", "__base", "__tokens", "__text", "Kept", "ids", "Items", "component_id", "set_key", "gram", "Score", "n_tokens")


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame(ROWS, "doc_id long, text string")
    return table.withColumns({c: F.lit(f"user {c}") for c in CLASHES})


def run_all(docs, labels, items):
    model = toxicity.train(docs, labels)
    return {
        1: byte_bpe.decode(byte_bpe.encode(docs)),
        2: token_counts.token_counts(docs),
        3: shards.shard_by_bytes(docs, 4),
        4: secrets.scan(docs),
        5: repeats.remove_repeats(docs),
        6: toxicity.score(docs, model),
        8: quality.quality_rules(docs),
        9: decontaminate.mark(docs, items),
        10: near_dups.near_duplicates(docs),
    }


def test_rows_stay_and_names_may_clash(spark, docs):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0)], "doc_id long, toxic int, quality int")
    items = spark.createDataFrame([(1, ROWS[2][1]), (2, None), (3, "")], "item_id long, text string")
    for n, found in run_all(docs, labels, items).items():
        rows = found.collect()
        assert len(rows) == len(ROWS), n
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in ROWS), n
        if n in (3, 4):
            outputs = {"size", "text_crc32", "law", "shard", "slot", "grown_shard", "spans"}
            for c in CLASHES:
                if c.lower() not in outputs:
                    assert {r[c] for r in rows} == {f"user {c}"}, (n, c)
        if n == 1:
            assert {(r["doc_id"], r["decoded"].decode()) for r in rows} == {(i, t or "") for i, t in ROWS}
    for n, found in run_all(docs.where("false"), labels, items).items():
        assert found.count() == 0, n
    empty = chat.format_log(spark.createDataFrame([], "conv long, seq long, message long, role string, kind string, text string"))
    assert chat.parse(empty).count() == 0
    log = [(1, k, 1, "user", "message" if k == 0 else "delta", LONG[:1000]) for k in range(200)] + [(1, 300, 2, "assistant", "message", "x"), (1, 300, 2, "assistant", "message", "x"), (None, 1, 1, None, None, None)]
    read = {r["conv"]: r for r in chat.parse(chat.format_log(spark.createDataFrame(log, "conv long, seq long, message long, role string, kind string, text string"))).collect()}
    assert read[1]["messages"][0]["text"] == LONG[:1000] * 200 and tuple(read[None]["messages"][0]) == ("", "")


def thue_morse(n, a, b):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word[:n]


def test_words_that_collide_in_polynomial_hashes(spark):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.codec(byte_bpe.default_path()).ranks, special_tokens={})
    for n in (512, 1024, 2048):
        one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        codec = byte_bpe.Codec(byte_bpe.default_path())
        ids, before, _ = codec.encode(pa.array([one, two]))
        assert [ids[a:b].tolist() for a, b in zip(before, before[1:])] == [library.encode_ordinary(one), library.encode_ordinary(two)]
        assert quality.base_counts(pa.array([f"{one}\n{two}"]))["n_dup_lines"][0] == 0
        assert not set(near_dups.shingle_sets(pa.array([one, two]), 1)[0]) & set(near_dups.shingle_sets(pa.array([one, two]), 1)[1])


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(byte_bpe, "span_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    codec = byte_bpe.Codec(byte_bpe.default_path())
    texts = ["one two two three", "x" * 40 + " " + "y" * 40]
    ids, before, _ = codec.encode(pa.array(texts))
    assert [codec.decode(ids[a:b].tolist()).decode() for a, b in zip(before, before[1:])] == texts


def test_spans_hash_by_content():
    data = np.frombuffer(b"abcdefghijk" * 30, np.uint8)
    a, n = np.arange(0, 200), 77
    hashes = common.span_hashes(data, a, a + n)
    assert len(set(hashes.tolist())) == 11 and hashes[3] == hashes[14]
    grams = common.gram_hashes(data, 32)
    assert len(set(grams.tolist())) == 11


def test_piece_model_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["two  words", "", None, " lead", "日本 x", LONG[:5000]]
    found = {r["i"]: r["n_tokens"] for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), path=path).collect()}
    assert found == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


def test_shards_keep_groups_and_sizes(spark):
    texts = [prose(rng.randrange(5, 40)) for _ in range(2000)]
    rows = [(i, texts[i % 1500]) for i in range(2000)] + [(5000 + i, "hot " * 20) for i in range(900)]
    found = shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    sizes, groups = {}, {}
    for r in found:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    mean = sum(sizes.values()) / 10
    assert set(sizes) == set(range(10)) and all(abs(s - mean) < 0.05 * mean for s in sizes.values())
    assert sum(len(g) > 1 for g in groups.values()) == 1  # the hot text alone, which is larger than a shard


def test_quality_bands_reject_by_each_measure(spark):
    good = [(i, prose(60)) for i in range(200)]
    odd = [(1000, " ".join(rng.choice("ab") for _ in range(60))), (1001, " ".join("𐍈𐎀𐎁"[rng.randrange(3)] * 3 + rng.choice(VOCAB) for _ in range(60))), (1002, " ".join(rng.choice(["international", "responsibility", "communication", "understanding", "government", "development"]) + str(i) for i in range(60)))]
    docs = spark.createDataFrame(good + odd, "doc_id long, text string")
    bands = quality.fit_bands(docs, spark.createDataFrame([(i, 1) for i, _ in good], "doc_id long, quality int"))
    found = {r["doc_id"]: r for r in quality.quality_rules(docs, bands=bands).collect()}
    assert all(found[i]["kept"] for i, _ in good) and not any(found[i]["kept"] or found[i]["base_failed"] for i, _ in odd)
    lo, hi, share, bits = bands["latin"]
    assert found[1000]["token_entropy"] < bits and found[1001]["fallback_share"] > share and found[1002]["chars_per_token"] > hi
    for i, t in good[:20] + odd:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), 0, len(hit))


def test_near_duplicates_of_a_large_group_make_few_candidates(spark, monkeypatch):
    """Copies of one text with edits of their own: components equal brute force, and candidates don't grow with the square."""
    def made(n, seed):
        draw = random.Random(seed)
        base = [f"v{draw.randrange(10_000)}" for _ in range(110)]
        out = [" ".join(base)]
        for _ in range(n - 1):
            words = list(base)
            for place in draw.sample(range(110), draw.randrange(1, 15)):
                words[place] = f"x{draw.randrange(10**9)}"
            out.append(" ".join(words))
        return out

    counts, plain = {}, near_dups._by_differences

    def counted(*args):
        found = plain(*args)
        counts["pairs"] = found[0].count() if found else 0
        return found

    monkeypatch.setattr(near_dups, "_by_differences", counted)
    grown = []
    for n in (200, 400):
        texts = made(n, n)
        sets = [frozenset(zip(w, w[1:], w[2:])) for w in map(str.split, texts)]
        label = list(range(n))
        find = lambda i: i if label[i] == i else find(label[i])
        for a in range(n):
            for b in range(a):
                if find(a) != find(b) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    label[y] = x
        rows = near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=3, percent=85).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == {i: find(i) for i in range(n)}
        grown.append(counts["pairs"])
    assert grown[1] <= 2 * max(grown[0], 20) and grown[1] < 400


def test_held_out_strings_are_found_and_identifiers_left(spark):
    """Recall on random strings and false positives on identifiers, none of which the models were trained on."""
    import base64

    draw = random.Random(99)
    train = spark.createDataFrame([(i, prose(120)) for i in range(200)], "doc_id long, text string")
    ratios = secrets.train(train)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(draw.choice(alphabet) for _ in range(24)) for _ in range(60)] + [base64.b64encode(draw.randbytes(18)).decode() for _ in range(60)]
    w = lambda: draw.choice(VOCAB)
    names = [f"{w()}_{w()}_{w()}" for _ in range(40)] + [w() + w().title() + w().title() for _ in range(40)] + [f"{w()}/{w()}-2024-01" for _ in range(40)] + [w().upper() + "_" + w().upper() for _ in range(40)]
    rows = [(i, f"the {t} end") for i, t in enumerate(keys + names)]
    found = {r["doc_id"]: r["n"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), ratios=ratios).select("doc_id", F.size("spans").alias("n")).collect()}
    assert sum(found[i] > 0 for i in range(120)) >= 114
    assert sum(found[i] > 0 for i in range(120, 280)) <= 8


def test_one_transition_does_not_decide_on_a_token(spark):
    """Identifiers of words with rare pairs of letters, which the training sample lacks, stay; random strings are still found."""
    draw = random.Random(17)
    ratios = secrets.train(spark.createDataFrame([(i, prose(120)) for i in range(200)], "doc_id long, text string"))
    assert max(ratios) < secrets.LEAST_ODDS / 2
    words = [w for w in VOCAB if len(w) > 3][:200]
    rare = [w[:2] + draw.choice("qxz") + draw.choice("jkw") + w[2:] for w in words]
    found = {r["doc_id"]: r["n"] for r in secrets.scan(spark.createDataFrame(list(enumerate(rare)), "doc_id long, text string"), ratios=ratios).select("doc_id", F.size("spans").alias("n")).collect()}
    assert sum(n > 0 for n in found.values()) <= len(rare) // 10


def test_sha_of_secrets_base_equals_brute_force(spark):
    texts = ["token: abcdefgh PASSWORD='12345678' api_key=x", "secret = short7 secret=longenough8", "AKIA" + "A" * 12 + " AKIAB", "a" * 31 + "g" + "0f" * 16, "😀 api-key token=éabcdefgh", ""]
    patterns = [(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32)]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        want = sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(patterns) for m in re.finditer(p, texts[r["doc_id"]]) if len(m.group(g)) >= least)
        assert [(s["start"], s["rank"], s["end"]) for s in r["spans"] if s["rank"] < 3] == want
