"""Operators 5, 7 and 8 and the pipeline: against brute force, and on odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from findloom.llm import decontam, quality, queries, simhash, words

SYLLABLES = "ka lo mi ter ban dro ful gis hep nor pal quo rin sul tav wex yon zet".split()


def prose(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def edited(r, text, edits):
    chars = list(text)
    for _ in range(edits):
        k = r.randrange(len(chars))
        r.choice([lambda: chars.pop(k), lambda: chars.insert(k, r.choice("xyz")), lambda: chars.__setitem__(k, r.choice("xyz"))])()
    return "".join(chars)


class TestDecontamination:
    def test_finds_edited_passages_within_budget(self):
        r = random.Random(1)
        items = [prose(r, r.randint(15, 40)) for _ in range(20)]
        index = decontam.Items(list(range(20)), items)
        for n in range(120):
            k = n % 20
            budget = int(index.budget[k])
            passage = edited(r, items[k], r.randint(0, budget))
            text = prose(r, r.randint(0, 60)) + " " + passage + " " + prose(r, r.randint(0, 60))
            found = [x for x in index.regions(text) if x[0] == k]
            assert found, (n, k)
            _, start, end, edits = found[0]
            assert edits <= edit_distance(items[k], passage.strip()) + 1
            assert edits == edit_distance(items[k].lower(), " ".join(text[start:end].lower().split()))

    def test_leaves_other_texts_alone(self):
        r = random.Random(2)
        items = [prose(r, 30) for _ in range(30)]
        index = decontam.Items(list(range(30)), items)
        assert not any(index.regions(prose(r, 400)) for _ in range(40))
        half = items[0][: len(items[0]) // 2]
        assert not index.regions(prose(r, 30) + half + prose(r, 30))

    def test_query_against_brute_force(self, spark, tmp_path):
        """Every document against every item, over all substrings: found and not found alike."""
        r = random.Random(21)
        items = [prose(r, r.randint(4, 9)) for _ in range(6)]
        texts = []
        for k in range(70):
            own = items[k % 6]
            budget = min(int(0.1 * len(own)), (len(own) - decontam.Q) // decontam.Q)
            texts.append(" ".join([prose(r, r.randint(0, 6)), edited(r, own, r.randint(0, 2 * budget + 2)), prose(r, r.randint(0, 6))]))
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        fold = lambda t: " ".join(t.lower().split())
        want = set()
        for d, text in enumerate(map(fold, texts)):
            for i, item in enumerate(map(fold, items)):
                # Sellers: the last row of the distance table with free ends.
                row = [0] * (len(text) + 1)
                for x in item:
                    before, row[0] = row[0], row[0] + 1
                    for j, y in enumerate(text, 1):
                        before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
                if min(row) <= min(int(0.1 * len(item)), (len(item) - decontam.Q) // decontam.Q):
                    want.add((d, i, min(row)))
        got = {(r.doc_id, r.item_id, r.edits) for r in queries.op5_decontaminate(spark, str(tmp_path)).collect()}
        assert got == want and 20 < len(want) < 60
        left = decontam.without_passages(*(spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "benchmark")))
        assert {r.doc_id for r in left.collect()} == set(range(70)) - {d for d, *_ in want}

    def test_every_verbatim_item_of_the_tables(self, spark, sf_dir):
        fold = lambda t: " ".join(t.lower().split())
        docs = {r.doc_id: fold(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
        items = {r.item_id: fold(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
        want = {(d, i) for d, text in docs.items() for i, item in items.items() if item in text}
        got = {(r.doc_id, r.item_id) for r in queries.op5_decontaminate(spark, sf_dir).collect()}
        assert want <= got

    def test_alignment_against_brute_force(self):
        r = random.Random(5)
        as_array = lambda s: np.array([ord(c) for c in s], np.uint32)
        for _ in range(60):
            own, window = ("".join(r.choice("ab") for _ in range(n)) for n in (r.randint(1, 9), r.randint(0, 14)))
            best = min(edit_distance(own, window[i:j]) for i in range(len(window) + 1) for j in range(i, len(window) + 1))
            edits, start, end = decontam.banded_alignment(as_array(own), as_array(window), 99, -len(own), len(window))
            assert edits == best == edit_distance(own, window[start:end])
            # A band around the place found is enough; one beside it is not filled.
            shift = max(1, edits)
            assert decontam.banded_alignment(as_array(own), as_array(window), 99, start - shift, start + shift)[0] == best
            if edits == 0:
                low = len(window) + 2
                assert decontam.banded_alignment(as_array(own), as_array(window), len(own) - 1, low, low + 3)[0] > len(own)

    def test_repetitive_text_in_bounded_memory(self):
        import tracemalloc

        index = decontam.Items([1], ["a" * 1000])
        tracemalloc.start()
        found = index.regions("a" * 100_000)
        assert tracemalloc.get_traced_memory()[1] < 300 << 20
        tracemalloc.stop()
        assert found[0][1:] == (0, 1000, 0) and len(found) >= 50 and all(a[2] <= b[1] for a, b in zip(found, found[1:]))
        assert not index.holds("a" * 800 + "b" * 200 + "a" * 700)

    def test_case_space_and_places(self):
        item = "Some Benchmark   Passage, with words to find again"
        index = decontam.Items([7], [item])
        text = "\n  Other. some\nbenchmark passage, WITH words to  find again. More"
        (found,) = index.regions(text)
        assert found[0] == 7 and found[3] == 0 and text[found[1] : found[2]] == "some\nbenchmark passage, WITH words to  find again"

    def test_odd_rows(self, spark):
        item = "a benchmark passage that is long enough to search for"
        docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, item, 5), (3, item, 5), (None, "x " + item, 5), (4, "y " * 60_000 + item, 5)], "doc_id long, text string, item_id int")
        bench = spark.createDataFrame([(1, item), (2, None), (3, "Long"), (4, item), (5, " "), (6, "sear")], "item_id long, text string")
        got = sorted((r.doc_id or 0, r.item_id) for r in decontam.find_passages(docs, bench).collect())
        # Short items are found as whole words, and drop no document.
        assert got == sorted((d, i) for d in (0, 3, 3, 4) for i in (1, 3, 4))
        short = decontam.without_passages(docs, bench.where("item_id in (3, 6)"))
        assert short.count() == 6
        kept = decontam.without_passages(docs, bench)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
        assert decontam.find_passages(docs.limit(0), bench).count() == 0 == decontam.find_passages(docs, bench.limit(0)).count()
        assert decontam.without_passages(docs, bench.limit(0)).count() == 6

    def test_blocks_of_items(self, spark, monkeypatch):
        r = random.Random(3)
        items = [prose(r, 30) for _ in range(12)]
        monkeypatch.setattr(decontam, "BLOCK_BYTES", 500)
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        docs = spark.createDataFrame([(1, items[3] + " " + items[9])], "doc_id long, text string")
        assert {r.item_id for r in decontam.find_passages(docs, bench).collect()} == {3, 9}
        assert decontam.without_passages(docs, bench).count() == 0


    def test_an_index_a_block_for_all_batches(self, monkeypatch):
        """Three blocks of items and eight batches: three indexes."""
        made = []

        class Own:
            def __iter__(self):
                for k in range(3):
                    made.append(k)
                    yield k

        batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [f"{k % 3}"]}) for k in range(8)]
        look = lambda items, batch, _: [(0, items)] if batch.column(1)[0].as_py() == str(items) else []
        got = [(b.column(0)[0].as_py(), found) for b, found in decontam._searched(iter(batches), Own(), look, list)]
        assert got == [(k, [(0, k % 3)]) for k in range(8)]
        assert made == [0, 1, 2]
        made.clear()
        monkeypatch.setattr(decontam, "GROUP_BYTES", 1)
        assert len(list(decontam._searched(iter(batches), Own(), look, list))) == 8
        # The last, empty group asks once more.
        assert len(made) == 3 * 9


class TestQuality:
    @pytest.fixture
    def tables(self, spark):
        r = random.Random(8)
        rows, labels = [], []
        for k in range(900):
            text, bad = prose(r, r.randint(30, 200)), k % 5 == 0
            if bad:
                kind = r.randrange(3)
                text = text.upper().replace(" ", "!! ") if kind == 0 else " ".join([SYLLABLES[k % 9]] * 80) if kind == 1 else text.replace(" ", " nastyword ", 4) + " vileword"
            rows.append((k, text, "extra"))
            if k % 2 == 0:
                labels.append((k, int(not bad), 0))
        return spark.createDataFrame(rows, "doc_id long, text string, key string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def test_rejects_bad_and_keeps_good(self, tables):
        docs, labels = tables
        got = {r.doc_id: r.selected for r in quality.importance(docs, labels).collect()}
        good, bad = [got[k] for k in range(900) if k % 5], [got[k] for k in range(900) if k % 5 == 0]
        assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1
        kept = quality.selected(docs, labels)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s}

    def test_many_copies_of_a_clean_text_stay(self, spark, tables):
        docs, labels = tables
        copy = prose(random.Random(99), 80)
        more = docs.unionByName(spark.range(10_000, 10_600).select(F.col("id").alias("doc_id"), F.lit(copy).alias("text"), F.lit("").alias("key")))
        got = quality.importance(more, labels)
        assert got.where("doc_id >= 10000 and not selected").isEmpty()

    def test_the_pipeline_draws_by_both_ratios(self, spark, tables, tmp_path, monkeypatch):
        """The stage is a Gumbel top-k: of as many documents as the filter selects, those of the largest keys."""
        docs, labels = tables
        labels.write.parquet(f"{tmp_path}/labels.parquet")
        # A cut at which the draw and the filter differ.
        monkeypatch.setattr(quality, "separating_weight", lambda good, bad: 0.0)
        rows = quality.importance(docs, labels).withColumn("both", quality.gumbel_key(F.col("log_weight") + F.col("filter_weight"), F.col("doc_id"))).collect()
        fits = {r.doc_id for r in rows if r.selected}
        want = {r.doc_id for r in sorted(rows, key=lambda r: -r.both)[: len(fits)]}
        kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
        got = {r.doc_id for r in kept.collect()}
        assert kept.columns == docs.columns and got == want and got != fits

    def test_the_pipeline_keeps_good_and_many_copies(self, spark, tables, tmp_path):
        docs, labels = tables
        labels.write.parquet(f"{tmp_path}/labels.parquet")
        copy = prose(random.Random(99), 80)
        more = docs.unionByName(spark.range(10_000, 10_600).select(F.col("id").alias("doc_id"), F.lit(copy).alias("text"), F.lit("").alias("key")))
        got = {r.doc_id for r in corpus_pipeline.keep_quality(spark, more, str(tmp_path)).collect()}
        good, bad, copies = [k in got for k in range(900) if k % 5], [k in got for k in range(900) if k % 5 == 0], got & set(range(10_000, 10_600))
        # A draw may leave a few at its edge.
        assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1 and len(copies) > 594

    def test_kth_largest(self, spark):
        r = random.Random(4)
        values = [r.choice([0.0, r.gauss(0, 1), r.gauss(0, 1000)]) for _ in range(500)]
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        for k in (1, 2, 77, 250, 499, 500):
            assert quality.kth_largest(rows, "x", k, bins=7) == sorted(values, reverse=True)[k - 1]
        assert quality.kth_largest(rows, "x", 0) == np.inf and quality.kth_largest(rows.limit(0), "x", 3) == np.inf

    def test_features_do_not_depend_on_neighbours(self):
        texts = ["One two two", "", None, "é" * 10, "a " * 600_000, "!!", "x"]
        lists = lambda found: [tuple(x.tolist()) for x in found]
        alone = [lists(next(quality.features(pa.array([t], pa.string())))) for t in texts]
        assert [lists(f) for f in quality.features(pa.array(texts, pa.string()))] == alone

    def test_weights_against_brute_force(self, spark, tables):
        """log p(target) - log p(raw) by counting words and pairs one by one."""
        import math
        from collections import Counter

        docs, labels = tables
        texts = {r.doc_id: r.text for r in docs.collect()}
        good = {r.doc_id for r in quality.labelled_sample(labels).collect() if r.good and not r.held_out}

        def slots(text):
            clean = "".join(c if c.isalnum() else " " for c in text).lower().split()
            named = []
            for w in clean:
                hashed, _ = words.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))
                named.append(int(hashed[0]))
            mask, base = (1 << 64) - 1, int(words.BASE)
            pairs = [int(words.mixed(np.array([(a * base + b) & mask], np.uint64))[0]) for a, b in zip(named, named[1:])]
            return [h >> 64 - quality.PAIR_BITS for h in named + pairs]

        own = {k: slots(t) for k, t in texts.items()}
        raw, target = Counter(s for v in own.values() for s in v), Counter(s for k in good for s in own[k])
        n, total_raw, total_target = 1 << quality.PAIR_BITS, raw.total(), target.total()
        ratio = lambda s: math.log((target[s] + 1) / (total_target + n)) - math.log((raw[s] + 1) / (total_raw + n))
        got = quality.importance(docs, labels).collect()
        for r in got:
            assert abs(r.log_weight - sum(map(ratio, own[r.doc_id])) / len(own[r.doc_id])) < 2e-6
        # Top-k: half of the rows, those of the largest keys.
        assert sum(r.drawn for r in got) == 450 and min(r.key for r in got if r.drawn) > max(r.key for r in got if not r.drawn)

    def test_draws_follow_the_weights(self, spark):
        """The largest key is that of a document with a chance proportional to its weight."""
        weight = F.element_at(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), F.col("d").cast("int") + 1)
        rows = spark.range(30_000).select((F.col("id") % 3).alias("d"), F.floor(F.col("id") / 3).alias("seed"))
        keyed = rows.withColumn("key", quality.gumbel_key(weight, F.col("d"), F.col("seed")))
        first = dict(keyed.groupBy("seed").agg(F.max_by("d", "key").alias("d")).groupBy("d").count().collect())
        shares = np.exp([0.0, 1.0, 2.0]) / np.exp([0.0, 1.0, 2.0]).sum()
        assert all(abs(first[k] / 10_000 - shares[k]) < 0.02 for k in range(3))

    def test_gumbel_noise_is_gumbel(self, spark):
        x = [r[0] for r in spark.range(20_000).select(quality.gumbel_key(F.lit(0.0), F.col("id"))).collect()]
        assert abs(np.mean(x) - 0.5772) < 0.05 and abs(np.std(x) - np.pi / 6**0.5) < 0.05

    def test_odd_rows(self, spark, tables):
        _, labels = tables
        rows = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y"), (4, "word " * 60_000)], "doc_id long, text string")
        got = quality.importance(rows, labels).collect()
        assert len(got) == 6 and [r.log_weight for r in got if r.doc_id in (1, 2)] == [0.0, 0.0]
        assert quality.importance(rows.limit(0), labels).count() == 0
        assert quality.importance(rows, labels.limit(0)).where("selected").count() == 6
        twice = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
        assert {(r.doc_id, r.good) for r in quality.labelled_sample(twice).collect()} == {(1, False), (2, True)}


class TestWords:
    def test_hashes_name_words(self):
        texts = ["A b", " a\tB  c", "", "b", "ab"]
        found = {}
        for first, data, offsets in words.chunks(pa.array(texts)):
            hashes, bounds = words.word_hashes(data, offsets)
            for k in range(len(offsets) - 1):
                for h, w in zip(hashes[bounds[k] : bounds[k + 1]].tolist(), texts[first + k].lower().split(), strict=True):
                    assert found.setdefault(w, h) == h
        assert len(set(found.values())) == len(found) == 4

    def test_shingles(self):
        r = random.Random(6)
        texts = [" ".join(r.choice("abc") for _ in range(n)) for n in (0, 1, 3, 5, 6, 40)]
        seen: dict = {}
        for _, data, offsets in words.chunks(pa.array(texts)):
            hashes, bounds = words.shingle_hashes(*words.word_hashes(data, offsets), 5)
            for k, text in enumerate(texts):
                own = text.split()
                want = [tuple(own[i : i + 5]) for i in range(len(own) - 4)] if len(own) >= 5 else [tuple(own)] * bool(own)
                got = hashes[bounds[k] : bounds[k + 1]].tolist()
                assert len(got) == len(want)
                for h, s in zip(got, want):
                    assert seen.setdefault(s, h) == h
        assert len(set(seen.values())) == len(seen)

    def test_chunks_of_slices_and_long_texts(self):
        texts = pa.array(["a" * 700_000, None, "b" * 2_000_000, "c"]).slice(1)
        got = [(first, bytes(d)[:1], list(o)) for first, d, o in words.chunks(texts)]
        assert got == [(0, b"", [0, 0]), (1, b"b", [0, 2_000_000]), (2, b"c", [0, 1])]
        assert list(words.chunks(pa.array([], pa.string()))) == []


def copies(r, n=60):
    """Texts in groups: exact copies, near copies, chains, and texts of their own."""
    out = []
    for _ in range(n):
        base = prose(r, r.randint(3, 150)).split()
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(SYLLABLES)
            out.append(" ".join(own))
    return out


class TestNearDuplicates:
    def groups(self, pairs, n):
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [root(k) for k in range(n)]

    def fingerprint(self, text, n=3):
        own = (text or "").encode().lower().split()
        parts = [b" ".join(own[k : k + n]) for k in range(len(own) - n + 1)] if len(own) >= n else [b" ".join(own)] * bool(own)
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    @pytest.mark.parametrize("shard_rows", [2000, 2])
    def test_exact_form(self, spark, monkeypatch, shard_rows):
        monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
        texts = [*copies(random.Random(7)), "", None, " \n", "A b C", "a B c", "word " * 40_000]
        rows = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, fp int")
        fps = [self.fingerprint(t) for t in texts]
        pairs = [(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 3]
        got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(rows, 3, 3).collect()}
        assert got == {k: (fps[k], c) for k, c in enumerate(self.groups(pairs, len(fps)))}

    def test_fingerprints_at_close_distance(self, spark):
        """Nodes at every distance from 0 to 5 from each other, in shards that are cut."""
        r = random.Random(9)
        values = set()
        for _ in range(12):
            x = r.getrandbits(64)
            values.add(x)
            for _ in range(12):
                y = x
                for b in r.sample(range(64), r.randint(1, 5)):
                    y ^= 1 << b
                values.add(y)
                x = r.choice([x, y])
        values = sorted(values)
        pairs = [(a, b) for b in range(len(values)) for a in range(b) if (values[a] ^ values[b]).bit_count() <= 3]
        want = self.groups(pairs, len(values))
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
        for rows in (2000, 3):
            simhash.SHARD_ROWS, before = rows, simhash.SHARD_ROWS
            try:
                links = [(r.u, r.v) for r in simhash.exact_links(nodes, 3).collect()]
            finally:
                simhash.SHARD_ROWS = before
            at = {signed(v): k for k, v in enumerate(values)}
            assert self.groups([(at[u], at[v]) for u, v in links], len(values)) == want

    def test_tree_finds_what_a_scan_finds(self):
        r = random.Random(10)
        center = r.getrandbits(64)
        values = sorted({center ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(700)})
        links, doubtful, more = simhash.linked(values, 3, 64)
        at = {v: k for k, v in enumerate(values)}
        pairs = [(a, b) for b in range(len(values)) for a in range(b) if (values[a] ^ values[b]).bit_count() <= 3]
        assert self.groups([(at[x], at[y]) for x, y in links], len(values)) == self.groups(pairs, len(values))
        assert not doubtful and not more

    def jaccard(self, texts, n=5):
        sets = []
        for t in texts:
            own = (t or "").lower().split()
            sets.append({tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if len(own) >= n else {tuple(own)})
        return [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]

    @pytest.mark.parametrize("shard_rows", [2000, 3])
    def test_similarity_form(self, spark, monkeypatch, shard_rows):
        monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
        texts = copies(random.Random(11), 120)
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = self.groups(self.jaccard(texts), len(texts))
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, 5, similarity=0.8).collect()}
        # Never joined wrongly; all but a few links found, however small a shard is cut.
        assert all(want[got[k]] == want[k] for k in got)
        assert sum(got[k] != want[k] for k in got) <= 2

    def test_a_large_group_of_near_copies(self, spark):
        r = random.Random(12)
        base = prose(r, 90).split()
        texts = []
        for _ in range(400):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(SYLLABLES)
            texts.append(" ".join(own))
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = self.groups(self.jaccard(texts), len(texts))
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, 5, similarity=0.8).collect()}
        assert all(want[got[k]] == want[k] for k in got) and sum(got[k] != want[k] for k in got) <= 4

    def test_all_nodes_of_a_large_shard_meet(self, spark, monkeypatch):
        monkeypatch.setattr(simhash, "SHARD_ROWS", 6)
        fps = [bytes([k]) for k in range(60)]
        large = spark.createDataFrame([(f, 0, v) for v in (1, 2) for f in fps], "fp binary, band int, value long")
        label = {f: fps[1] if k % 3 else (fps[3] if k % 2 else None) for k, f in enumerate(fps)}
        classes = spark.createDataFrame([(f, c) for f, c in label.items() if c], "node binary, component binary")
        shards: dict = {}
        for row in simhash.met_in_blocks(large, classes).collect():
            assert (bytes(row.label) if row.label else None) == label[bytes(row.fp)]
            shards.setdefault((row.value, row.part), set()).add(bytes(row.fp))
        assert max(map(len, shards.values())) <= 18
        for v in (1, 2):
            met = {(a, b) for (value, _), own in shards.items() if value == v for a in own for b in own}
            assert all((a, b) in met for a in fps for b in fps if a != b and (label[a] is None or label[a] != label[b]))
        # Blocks of one component do not meet.
        assert not any({label[f] for f in own} == {fps[1]} for own in shards.values())

    def test_plans_for_more_texts_find_as_much(self):
        """Pairs at the bit distances of similarity 0.8, by the bands for 10 thousand to 10 billion texts."""
        r = np.random.default_rng(3)
        for nodes in (10**4, 10**8, 10**10):
            bits, bands = simhash.band_plan(nodes, 0.8)
            assert nodes / 2**bits <= 1000 and len(set(map(tuple, simhash.band_places(bits, bands)))) == bands
            places = simhash.band_places(bits, bands)
            assert all(len(set(row)) == bits for row in places.tolist())
            differs = r.random((4000, 64 * simhash.LONG_WORDS)) < simhash._differing(0.8)
            assert (~differs[:, places].any(axis=2)).any(axis=1).mean() > 0.945

    @pytest.mark.parametrize("shard_rows", [2000, 1])
    def test_recall_at_the_threshold(self, spark, monkeypatch, shard_rows):
        """Lone pairs of similarity 0.8 to 0.87 against brute force, with shards whole and with every shard cut."""
        monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
        monkeypatch.setattr(simhash, "band_plan", lambda nodes, similarity: (14, 32))
        r = random.Random(16)
        texts = []
        for _ in range(200):
            own = prose(r, 120).split()
            other = list(own)
            for at in r.sample([10, 30, 50, 70, 90, 110], 2):
                other[at] = "changed"
            texts += [" ".join(own), " ".join(other)]
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = self.groups(self.jaccard(texts), len(texts))
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, 5, similarity=0.8).collect()}
        linked = [k for k in got if want[k] != k]
        assert len(linked) == 200 and all(want[got[k]] == want[k] for k in got)
        assert sum(got[k] == want[k] for k in linked) / len(linked) >= 0.95

    def test_small_sets_are_linked_exactly(self, spark):
        """Texts of up to 14 words, with words added, left out and changed, against brute force."""
        r = random.Random(17)
        texts = []
        for _ in range(120):
            own = prose(r, r.randint(0, 14)).split()
            texts.append(" ".join(own))
            for _ in range(3):
                other = list(own)
                for _ in range(r.randint(0, 2)):
                    k = r.choice([0, len(other)])
                    r.choice([lambda: other.insert(k, "w"), lambda: other and other.pop(min(k, len(other) - 1)), lambda: other.append(r.choice("ab"))])()
                texts.append(" ".join(other))
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        pairs = [(a, b) for a, b in self.jaccard(texts) if texts[a].split() or not texts[b].split()]
        want = self.groups(pairs, len(texts))
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, 5, similarity=0.8).collect()}
        assert got == dict(enumerate(want)) and len(set(want)) < len(set(texts))

    def test_one_of_each_group_stays(self, spark):
        text = prose(random.Random(13), 50)
        rows = [(3, text, 1), (2, text, 1), (2, text, 1), (None, text, 1), (9, "", 1), (8, None, 1), (7, prose(random.Random(14), 50), 1)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
        out = simhash.kept(docs)
        assert out.columns == docs.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 7, 8]
        assert simhash.kept(docs.limit(0)).count() == 0

    def test_empty(self, spark):
        rows = spark.createDataFrame([], "doc_id long, text string")
        assert simhash.near_duplicates(rows, 3, 3).count() == 0 and simhash.near_duplicates(rows, 5, similarity=0.8).count() == 0
        for wrong in ({"radius": 4}, {"similarity": 0.5}):
            with pytest.raises(ValueError):
                simhash.near_duplicates(rows, 3, **wrong)


class TestPipeline:
    def test_stages(self):
        assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing"]
        assert corpus_pipeline.ORACLE_SQL is None

    def test_each_stage_on_its_own_input(self, spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = {r.doc_id: r.text for r in docs.collect()}
            docs = stage(spark, docs, sf_dir)
            after = {r.doc_id: r.text for r in docs.collect()}
            assert docs.columns == columns and after.items() <= before.items() and after, name
            if name == "near_duplicates":
                ids, texts = list(before), list(before.values())
                groups = TestNearDuplicates().groups(TestNearDuplicates().jaccard(texts), len(texts))
                assert set(after) == {min(ids[k] for k in range(len(ids)) if groups[k] == g) for g in set(groups)}
            if name == "decontamination":
                fold = lambda t: " ".join((t or "").lower().split())
                items = [fold(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
                assert set(before) - set(after) >= {k for k, t in before.items() if any(i in fold(t) for i in items)}

    def test_run(self, spark, sf_dir):
        rows = corpus_pipeline.run(spark, sf_dir).collect()
        assert rows and [r.position for r in rows] == sorted(r.position for r in rows)

    def test_columns_that_might_clash(self, spark, sf_dir):
        names = ["__id", "__rows", "__text", "__own", "__key", "__use", "own_id", "own_rows", "own_text", "own_key", "own_hash", "own_use", "head", "Words", "position", "id", "kind", "fp", "component_id"]
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        docs = docs.unionByName(docs.limit(20)).select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            first = docs.first()
            assert first is not None, name
            if name != "mixing":
                assert docs.columns == columns
        given = [c for c in columns if c not in ("Words", "position")]
        assert docs.columns == [*given, "use", "words", "position"]
        assert [first[n] for n in names[:13]] == list(range(13))

    def test_odd_documents_pass_every_stage(self, spark, sf_dir):
        schema = "doc_id long, text string, lang string, source string, n_chars long, label string"
        rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "some words here", "en", None, 15, "x"), (3, "w " * 50_000, "en", "s", 100_000, "x"), (3, "w " * 50_000, "en", "s", 100_000, "x")]
        for given in (rows, []):
            docs = spark.createDataFrame(given, schema)
            for _, stage in corpus_pipeline.STAGES:
                docs = stage(spark, docs.select(*schema.replace(" long", "").replace(" string", "").split(", ")), sf_dir)
                docs.collect()
