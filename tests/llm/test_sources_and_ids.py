"""Operators 11, 12 and 13 against brute force, and on rows that are null, empty, long, tied or repeated."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findloom.llm import divergence, hard_negatives, token_files
from findloom.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, term string, n int, value string, rank int"


def docs(spark, *rows):
    """(doc_id, text, lang, source) rows with columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, "x", 7, "y", 1) for r in rows], DOCS)


def audited(rows, least_docs):
    """The audit by dictionaries: {(lang, source, part, item): (value, rank)}."""
    by_lang = defaultdict(list)
    for _, text, lang, source in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        by_lang[lang or ""].append((source or "", re.findall(divergence.TERM, lower)))
    out = {}
    for lang, held in by_lang.items():
        in_docs = Counter(t for _, words in held for t in set(words))
        kept = sorted(t for t, n in in_docs.items() if n >= least_docs)
        counts = {s: Counter() for s, _ in held}
        for s, words in held:
            counts[s].update(w for w in words if in_docs[w] >= least_docs)
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in counts.items():
            pairs = [(sum(f(p(c, t), p(d, t)) for t in kept), o) for o, d in counts.items() if o != s]
            terms = [(f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= divergence.TOP:
                        out[lang, s, part, item] = value, rank
    return out


class TestDivergence:
    def check(self, spark, rows, least_docs=2, **more):
        got = divergence.audit(docs(spark, *rows), least_docs, **more).collect()
        found = {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in got}
        assert len(found) == len(got)
        assert found == audited(rows, least_docs)

    @pytest.mark.parametrize("tile", [256, 3])
    def test_against_brute_force(self, spark, monkeypatch, tile):
        monkeypatch.setattr(divergence, "VECTORS", 40)  # several salts
        rng = np.random.default_rng(5)
        words = ["été", "Ab", "aB", "ü", "x-y", "日本", "w1w", *(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120))]
        pick = lambda: " ".join(rng.choice(words, rng.integers(0, 30), p=np.arange(len(words), 0, -1) / sum(range(len(words) + 1))))
        rows = [(k, pick(), ["en", "fr"][int(rng.integers(2))], f"s{min(int(rng.exponential(4)), 11)}") for k in range(300)]
        self.check(spark, rows, tile=tile)

    def test_odd_rows(self, spark):
        rows = [(1, None, None, None), (1, "", "", "a"), (None, "a b a", "en", "x"), (None, "a b a", "en", "x"), (3, "b", "en", None), (4, "zz", "de", "p"), (5, "q q q", "de", "q"), (6, "123 _-", "es", "only")]
        self.check(spark, rows)
        assert divergence.audit(docs(spark)).count() == 0

    def test_a_long_text_counts_as_one_document(self, spark, monkeypatch):
        monkeypatch.setattr(divergence, "PIECE", 64)
        long = "alpha BETA " * 400 + "gamma" * 60 + " été " * 50
        self.check(spark, [(1, long, "en", "a"), (2, "alpha gamma", "en", "b"), (3, "delta " * 3 + "alpha", "en", "a"), (4, long, "en", "c")])

    def test_shares_are_exact(self, spark):
        counts, mass = np.array([0, 7, 10**15]), np.array([3, 10**12 + 39, 3 * 10**15 + 1])
        want = [1 + 10**9 * (int(c) + 2) // int(m) for c, m in zip(counts, mass)]
        assert divergence._shares(counts, mass).tolist() == want
        rows = spark.createDataFrame([(int(c), int(m)) for c, m in zip(counts, mass)], "c long, m long")
        assert [r[0] for r in rows.select(divergence.share(F.col("c"), F.col("m"))).collect()] == want

    def test_equal_vectors_are_one(self, spark):
        # Forty terms that differ in name only make two distinct vectors.
        rows = [(k, " ".join(f"t{chr(97 + j % 26)}{'x' * (j // 26)}" for j in range(40)) + (" odd" if k else ""), "en", f"s{k % 2}") for k in range(4)]
        kept = divergence.kept_terms(divergence.term_counts(docs(spark, *rows)), 2)
        assert (kept.count(), kept.select("vector").distinct().count()) == (41, 2)


VECTORS = "vec_id long, label int, embedding array<float>, id string, v int, norm int, score int"


def vectors(spark, *rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VECTORS)


def mined(rows, k=5):
    """Hard negatives by sorting all scores of each anchor."""
    own = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)))

    def score(a, b):
        n = min(len(a), len(b))
        return int(a[:n] @ b[:n])

    out = []
    for i, label, v in own:
        if i % 100:
            continue
        near = sorted((-score(v, w), j) for j, other, w in own if other == label and j != i)[:k]
        far = sorted((-score(v, w), j) for j, other, w in own if other != label and j != i)
        for s, j in near:
            fits = [(-t, n) for t, n in far if 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, j, rank, n, -s, t) for rank, (t, n) in enumerate(fits, 1)]
    return sorted(out)


class TestHardNegatives:
    def found(self, spark, rows, **more):
        ints = hard_negatives.integer_rows(vectors(spark, *rows), hard_negatives.confused_label())
        return sorted(map(tuple, hard_negatives.mine(ints, ints.where("id % 100 = 0"), **more).collect()))

    @pytest.mark.parametrize(("bucket", "anchors"), [(2048, 1024), (16, 2)])
    def test_against_brute_force(self, spark, monkeypatch, bucket, anchors):
        monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
        monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
        rng = np.random.default_rng(3)
        centres = rng.normal(size=(6, 5))
        rows = [(k, int(rng.integers(4)), (centres[k % 6] * rng.exponential() + rng.normal(size=5) / 5).astype(np.float32).tolist()) for k in range(900)]
        got = self.found(spark, rows)
        assert got == mined(rows)
        assert len(got) > 50

    def test_ties_go_by_id(self, spark):
        rows = [(k, k % 2, [1.0, 1.0]) for k in range(60)]
        got = self.found(spark, rows)
        assert got == mined(rows)
        # Id 0 counts as label 1, as the odd ids do but for 7, which counts as 2.
        assert [r[3] for r in got if r[1] == 3] == [2, 4, 6, 7, 8]

    def test_odd_rows(self, spark):
        nan, inf = float("nan"), float("inf")
        rows = [(0, 1, [1.0, 0.5]), (1, 2, [1.0]), (2, 2, [1.0, 0.5]), (3, None, [1.0, 0.5]), (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [nan, 1.0]), (None, 2, [1.0, 0.5]), (8, 2, [inf]), (9, 3, [0.9, 0.5, 9.0]), (10, 2, []), (100, 2, [-1.0, 0.0]), (11, 2, [0.5, 0.0]), (9, 3, [0.9, 0.5, 9.0])]
        assert self.found(spark, rows) == mined(rows)
        assert self.found(spark, []) == []
        assert self.found(spark, [(0, 1, [1.0])]) == []

    def test_negative_scores_have_no_window(self, spark):
        rows = [(0, 1, [1.0]), (1, 2, [-1.0]), (2, 3, [-0.9]), (3, 3, [-1.0])]
        assert self.found(spark, rows) == mined(rows) == []

    def test_large_components_are_exact(self, spark):
        rows = [(0, 1, [3e5, 1.0]), (1, 2, [3e5, 0.5]), (2, 2, [3e5, 0.25]), (3, 3, [3e5 - 1, 1.0]), (4, 3, [2e5, -1.0])]
        assert self.found(spark, rows) == mined(rows)
        with pytest.raises(Exception, match="beyond 64 bits"):
            self.found(spark, [(0, 1, [3e9]), (1, 2, [3e9])])

    def test_short_vectors_are_passed_over(self, spark, monkeypatch):
        monkeypatch.setattr(hard_negatives, "BUCKET", 10)
        folder = new_path(spark, "hardneg-test")
        rows = [(k, 2 if k < 60 else 3, [10.0 / (1 + k % 60), 0.0]) for k in range(1, 120)]
        place = hard_negatives.write_buckets(hard_negatives.integer_rows(vectors(spark, *rows)), folder)
        buckets, read = hard_negatives._Buckets(folder, place), []
        inner = buckets._read
        buckets._read = lambda b: read.append(b["norm"]) or inner(b)
        anchor = np.array([[2560, 0]])
        found = list(hard_negatives.search(np.array([1000]), anchor, np.array([2560.0]), 2, buckets))
        assert found
        assert len(read) < len(buckets.index) / 2
        assert min(read) > min(b["norm"] for b in buckets.index)


LIBRARY = token_files._tokenizer(token_files.TOKENIZER)
TEXTS = st.text(st.sampled_from("aAbZé́ßΣσ'st09.,- \t\n\r\x0b\x0c\x1c\xa0 日本🙂<|>endoftext"), max_size=60)


def whole_text_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


class TestTokenFiles:
    @settings(max_examples=300, deadline=None)
    @given(st.lists(TEXTS, min_size=1, max_size=5))
    def test_pieces_give_the_ids_of_whole_texts(self, texts):
        found = token_files.Encoder().documents(pa.array(texts, pa.string()))
        assert [f.tolist() for f in found] == [whole_text_ids(t) for t in texts]

    def test_every_latin_character(self):
        texts = [f"x{chr(c)}y {chr(c)} {chr(c)}{chr(c)}. 1{chr(c)}'s" for c in (*range(1, 0x250), 0x1E9E, 0x2019, 0xFB01)]
        assert [f.tolist() for f in token_files.Encoder().documents(pa.array(texts))] == [whole_text_ids(t) for t in texts]

    def test_special_strings_and_long_texts(self, monkeypatch):
        monkeypatch.setattr(token_files, "STRETCH", 50)
        monkeypatch.setattr(token_files, "MEMORY", 5)
        texts = ["a<|endoftext|> b <|startoftext|>", "word " * 100, "x" * 300 + " y", " \n" * 80, "été " * 60 + "ü" * 200, "", "don't I'll " * 30]
        encoder = token_files.Encoder()
        for _ in range(2):
            assert [f.tolist() for f in encoder.documents(pa.array(texts))] == [whole_text_ids(t) for t in texts]

    @pytest.mark.parametrize("mode", ["byte", "bit"])
    @pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
    def test_planes_round_trip(self, mode, n):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
        planes = token_files.to_planes(ids, mode)
        assert len(planes) == token_files.PLANES[mode]
        assert token_files.of_planes(planes, n, mode).tolist() == ids.tolist()

    def check(self, spark, rows, **options):
        kind = "doc_id long, text string, start int, n_tokens string, h int, row int, part int"
        table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], kind)
        got = token_files.encoded(table, **options).orderBy("start").collect()
        at, want = 0, []
        for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = [*whole_text_ids(text), token_files.END_ID]
            want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert list(map(tuple, got)) == want

    @pytest.mark.parametrize("mode", ["byte", "bit"])
    @pytest.mark.parametrize("block", [3, 1 << 16])
    def test_files_against_whole_texts(self, spark, mode, block):
        rows = [(k * 37 % 101 - 5, "the word's été 日本 " * (k % 7) + str(k)) for k in range(100)]
        self.check(spark, [*rows, (1000, None), (1001, ""), (1002, " \n"), (None, "first")], mode=mode, block=block)

    def test_repeated_rows_and_empty_table(self, spark):
        self.check(spark, [(5, "same text")] * 20 + [(4, "other")])
        self.check(spark, [(1, "in one call"), (2, None)], pieces=False)
        self.check(spark, [])

    def test_rows_that_share_an_id_lie_together(self, spark):
        rows = spark.createDataFrame([(k % 2, f"w{k}") for k in range(40)], "doc_id long, text string")
        got = token_files.encoded(rows).orderBy("start").collect()
        assert [r.doc_id for r in got] == [0] * 20 + [1] * 20
        assert got == token_files.encoded(rows.repartition(3)).orderBy("start").collect()

    def test_any_range_of_ids(self, spark):
        rows = spark.createDataFrame([(k, "some words of text " * k) for k in range(60)], "doc_id long, text string")
        folder = new_path(spark, "tokens-test")
        manifest = token_files.write_tokens(rows, folder, block=100)
        whole = [i for k in range(60) for i in [*whole_text_ids("some words of text " * k), token_files.END_ID]]
        assert manifest.agg(F.sum("ids")).first()[0] == len(whole)
        for start, count in ((0, len(whole)), (0, 1), (99, 2), (100, 100), (len(whole) - 1, 5), (3210, 1234)):
            assert token_files.read_range(manifest, folder, start, count).tolist() == whole[start : start + count]

    def test_a_damaged_block_is_noticed(self, spark, tmp_path):
        rows = spark.createDataFrame([(1, "some text " * 50)], "doc_id long, text string")
        manifest = token_files.write_tokens(rows, f"file://{tmp_path}")
        path = tmp_path / manifest.first()["file"]
        data = bytearray(path.read_bytes())
        data[40] ^= 1
        path.write_bytes(data)
        with pytest.raises(Exception, match="checksum|decompress|corrupt"):
            token_files.read_tokens(manifest, f"file://{tmp_path}").collect()
