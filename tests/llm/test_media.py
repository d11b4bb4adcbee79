"""Operators 2, 6 and 10: round trips, held-out accuracy and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from findloom.llm import audio, html_extract, queries, warc


class TestHtml:
    @pytest.fixture
    def model(self):
        return html_extract.labeller()

    def test_held_out_pages(self, model):
        r = random.Random(4711)
        right = wrong = whole = 0
        for _ in range(300):
            blocks, labels = html_extract.labelled(html_extract.synthetic_page(r))
            if not blocks:
                continue
            same = (model.scores(html_extract.Batch([blocks])) > 0.5) == np.array(labels, bool)
            right, wrong, whole = right + same.sum(), wrong + (~same).sum(), whole + same.all()
        assert right / (right + wrong) > 0.995 and whole / 300 > 0.95

    def test_side_blocks_without_telling_names(self, model):
        body = "<h1>Harvest in the valley</h1><p>The farmers of the valley brought in the harvest before the rain came last week.</p><p>Nobody had expected so much of it, after such a dry and windy spring.</p>"
        want = "Harvest in the valley\n\nThe farmers of the valley brought in the harvest before the rain came last week.\n\nNobody had expected so much of it, after such a dry and windy spring."
        menu = "<table><tr><td><a href=/n>News</a></td><td><a href=/s>Sport</a></td></tr></table>"
        pages = [
            f'{menu}<div class="main">{body}</div><div id="bot">Copyright 2021</div>',
            f"<div><a href=/>Home</a> | <a href=/a>About</a> | <a href=/c>Contact</a></div><div>{body}</div><div>&copy; 2020 Valley Press</div>",
            f"<table><tr><td>{menu}</td><td>{body}</td></tr></table><div>All rights reserved.</div>",
            f"<div id=x>We use cookies to improve this site.</div><div id=c>{body}</div><p>Copyright 2019 Valley Press</p>",
        ]
        assert sum(got == want for got in html_extract.main_texts(pages, model)) >= 3

    def test_broken_pages_take_linear_time(self):
        import time

        for pattern in ("<script ", '<a b="', "<a ", "<a b=\"x'", '<a b=">', "<a c='\"> ", '<a b="><" c="><" ', "<!--", "<!-- <p>a", "<script>"):
            for tail in ("", "'", '">'):
                began = time.time()
                html_extract.blocks_of((pattern * (1 << 20))[: 1 << 20] + tail)
                assert time.time() - began < 8, (pattern, tail)

    def test_tags_end_where_they_should(self):
        page = """<p title="a > b">one</p><p title='x" y'>two</p><p title="open>three</p><a href=x'y>four</a><p a="1" b='2'>five"""
        assert [t for _, t, _ in html_extract.blocks_of(page)] == ["one", "two", "three", "four", "five"]
        assert html_extract.blocks_of("a <!-- b <p>c") and [t for _, t, _ in html_extract.blocks_of("a <!-- b <p>c")] == ["a"]
        deep = html_extract.blocks_of("<div>" * 5000 + "x")
        assert len(deep[0][0]) == html_extract.OUTER + html_extract.INNER

    def test_pages_of_the_table(self, spark, sf_dir):
        """The main text of these pages is their article element."""
        import html
        import re

        pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
        bodies = {r.page_id: re.search(r"(?s)<article>(.*?)</article>", r.html)[1] for r in pages.collect()}
        got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
        for k, body in bodies.items():
            parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p.replace("<b>", ""))).split()) for p in re.split(r"</?(?:p|h1)>", body))
            want = "\n\n".join(p for p in parts if p)
            assert got[k] == (want, len(want))

    def test_blocks(self):
        page = "<p>a <b>b</b>&amp;c<br>d<p>e<script>'</p>'</script> f<!-- <p> --><ul><li>g<li>h</ul> &nbsp; tail <a href='x>y'>i</a>"
        assert [t for _, t, _ in html_extract.blocks_of(page)] == ["a b&c d", "e f", "g", "h", "tail i"]

    def test_gradients(self):
        r = random.Random(2)
        pages = [html_extract.labelled(html_extract.synthetic_page(r)) for _ in range(3)]
        b, y = html_extract.Batch([p for p, _ in pages]), np.array([v for _, ys in pages for v in ys], np.float32)
        model = html_extract.Labeller(3)
        model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
        grads = model.gradients(b, y)

        def loss():
            s = np.clip(model.scores(b), 1e-9, 1 - 1e-9)
            return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

        for name, at in (("out", (3, 0)), ("hf", (1, 5)), ("xb", (2, 7)), ("bf", (4,)), ("path", (b.path_ids[0], 2)), ("word", (b.word_ids[0], 1))):
            model.p[name][at] += 1e-3
            up = loss()
            model.p[name][at] -= 2e-3
            down = loss()
            model.p[name][at] += 1e-3
            assert abs((up - down) / 2e-3 - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at])), name

    def test_odd_rows(self, spark):
        deep = "<div>" * 500 + "x"
        rows = [(1, None), (2, ""), (3, "no tags"), (4, "<p>" + "w " * 50_000), (5, "<p>a</p>"), (5, "<p>a</p>"), (6, deep), (7, "<<<p <>&#x110000; </"), (None, "<title>t</title>")]
        pages = spark.createDataFrame([(k, "u", h, "x") for k, h in rows], "page_id long, url string, html string, text string")
        got = html_extract.extract(pages).collect()
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
        assert html_extract.extract(pages.limit(0)).count() == 0


class TestWarc:
    def test_payloads_come_back(self, spark, tmp_path):
        big = "é<p>" * 500
        rows = [(1, "http://a/", big), (2, "http://b/ x\r\ny", big), (3, None, "small"), (4, "http://c/", "small"), (5, "u", None), (6, "u", ""), (7, "u", big + "\r\n\r\nWARC/1.1"), (None, "n", big), (2, "again", big), (8, "u", "z" * 300_000)]
        pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
        folder = f"file://{tmp_path}/w"
        index = warc.write_archives(pages, folder)
        assert not list((tmp_path / "w").glob("*.part"))
        got = sorted(((r.page_id is None, r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in warc.read_records(index, folder).collect())
        assert len(got) == len(rows)
        sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
        by_id = {k[1]: (t, to, n, d, p) for k, t, to, n, d, p in got if not k[0]}
        assert by_id[1] == ("revisit", 2, len(big.encode()), sha(big), None)
        assert by_id[2][:2] == ("response", None) and by_id[2][4] == big.encode()
        assert by_id[3][0] == by_id[4][0] == by_id[5][0] == by_id[6][0] == "response" and by_id[5][2:4] == (0, sha(""))
        assert by_id[7][4] == (big + "\r\n\r\nWARC/1.1").encode() and by_id[8][2] == 300_000

    def test_selected_records_only(self, spark, sf_dir, tmp_path):
        folder = f"file://{tmp_path}/w"
        index = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
        assert {r.page_id for r in warc.read_records(index.where("page_id % 7 = 0"), folder).collect()} == set(range(0, 50, 7))

    def test_archives_are_plain_warc(self, spark, tmp_path):
        import gzip

        folder = f"file://{tmp_path}/w"
        warc.write_archives(spark.createDataFrame([(1, "http://a/", "hello")], "page_id long, url string, html string"), folder)
        text = gzip.decompress(next((tmp_path / "w").glob("*.warc.gz")).read_bytes())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\nhello\r\n\r\n")

    def test_coalesced_reads(self):
        gap, most = warc.GAP_BYTES, warc.READ_BYTES
        assert warc.coalesced([(0, 10), (10, 5), (20 + gap, 5), (15 + 2 * gap + most, 5)]) == [(0, 15, [0, 1]), (20 + gap, 5, [2]), (15 + 2 * gap + most, 5, [3])]
        assert warc.coalesced([(0, 10), (10 + gap, 1)]) == [(0, 11 + gap, [0, 1])]
        assert warc.coalesced([]) == []

    def test_a_changed_archive_is_noticed(self, spark, tmp_path):
        folder = f"file://{tmp_path}/w"
        index = warc.write_archives(spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string"), folder)
        path = next((tmp_path / "w").glob("*.warc.gz"))
        raw = bytearray(path.read_bytes())
        raw[len(raw) // 2] ^= 0xFF
        path.write_bytes(raw)
        with pytest.raises(Exception, match="zlib|digest|decompress|invalid"):
            warc.read_records(index, folder).collect()

    def test_empty(self, spark, tmp_path):
        empty = spark.createDataFrame([], "page_id long, url string, html string")
        folder = f"file://{tmp_path}/w"
        assert warc.read_records(warc.write_archives(empty, folder), folder).count() == 0


class TestAudio:
    def test_digests_of_what_was_stored(self, spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
        for r in queries.op10_audio(spark, sf_dir).collect():
            raw = texts[r.doc_id]
            payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            medium = audio.encoded(payload)
            assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(medium))
            assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(medium).hexdigest())
            assert r.tail_crc32 == zlib.crc32(payload[-16:])

    def test_wav_is_read_by_the_standard_library(self):
        import io
        import wave

        payload = bytes(range(192))
        with wave.open(io.BytesIO(audio.encoded(payload))) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(999)) == (1, 1, 16_000, payload)

    def test_a_tone_rises_in_its_band(self):
        t = np.arange(16_000) / 16_000
        low, high = (audio.features(audio.encoded((128 + 100 * np.sin(2 * np.pi * f * t)).astype(np.uint8).tobytes()))[0] for f in (300, 2500))
        assert low.mean(axis=(0, 1)).argmax() < high.mean(axis=(0, 1)).argmax()

    def test_segments_follow_loudness(self):
        t = np.arange(16_000) / 16_000
        loud = np.where((t > 0.3) & (t < 0.6), 100 * np.sin(2 * np.pi * 800 * t), 0)
        tensor, spans = audio.features(audio.encoded((128 + loud).astype(np.uint8).tobytes()))
        assert len(spans) == 1 and abs(spans[0][0] - 0.3) < 0.05 and abs(spans[0][1] - 0.6) < 0.05 and tensor.shape == (1, audio.STEPS, audio.BANDS)

    def test_hysteresis(self):
        assert audio.segmented(np.array([0, 0, 10, 4, 4, 0, 4, 0.0])) == [(2, 5)]
        assert audio.segmented(np.array([0, 0, 9, 5, 5, 0, 0, 5, 5, 0, 9.0])) == [(2, 5), (10, 11)]
        assert audio.segmented(np.ones(4)) == [(0, 4)]

    @pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (3, 2), (4, 5)])
    def test_polyphase_against_a_plain_filter(self, monkeypatch, up, down):
        """Zeros put between samples, one filter over all, every down-th output kept."""
        monkeypatch.setattr(audio, "UP", up)
        monkeypatch.setattr(audio, "DOWN", down)
        raw = np.random.default_rng(0).integers(0, 256, 997).astype(np.uint8)
        x, taps = (raw.astype(float) - 128) / 128, audio._TAPS.astype(float)
        n = -(-len(x) * up // down)
        want = []
        for m in range(n):
            phase = taps[m * down % up :: up]
            at = m * down // up - len(taps) // 2 + np.arange(len(phase))
            inside = (at >= 0) & (at < len(x))
            want.append((phase[inside] * x[at[inside]]).sum())
        assert np.allclose(audio.resampled(raw), want, atol=1e-5)
        whole = audio.resampled(raw)
        for start, end in ((0, 60), (60, 61), (120, n)):
            assert np.array_equal(audio.resampled(raw, start, end), whole[start:end])

    def test_a_long_sound_takes_its_table_and_a_block(self):
        import tracemalloc

        sound = np.random.default_rng(1).integers(97, 122, 24_000_000).astype(np.uint8)
        sound[6_000_000:18_000_000] = 32  # a long quiet stretch
        medium = audio.encoded(sound.tobytes())
        tracemalloc.start()
        tensor, spans = audio.features(medium)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(tensor) == len(spans) > 1
        # The spectra of a block of frames are some 30 MB, for a sound of any length.
        assert peak < len(medium) + 40_000_000

    def test_features_against_a_plain_version(self):
        """Convolution, a filter at a time and a loop over frames, for the tensors and spans of a sound of two tones."""
        t = np.arange(9000) / 16_000
        sound = np.where((t > 0.1) & (t < 0.25), 90 * np.sin(2 * np.pi * 700 * t), 0) + np.where(t > 0.4, 60 * np.sin(2 * np.pi * 1500 * t), 0)
        raw = (128 + sound).astype(np.uint8)
        tensor, spans = audio.features(audio.encoded(raw.tobytes()))
        x = (raw.astype(float) - 128) / 128
        n = np.arange(32) - 15.5
        taps = np.sinc(n / 2) * np.hamming(32)
        taps /= taps.sum()
        slow = np.array([sum(taps[k] * x[2 * m + k - 16] for k in range(32) if 0 <= 2 * m + k - 16 < len(x)) for m in range(len(x) // 2)])
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        edges = [700 * (10 ** (mel(4000) * b / (audio.BANDS + 1) / 2595) - 1) for b in range(audio.BANDS + 2)]
        frames = []
        for at in range(0, len(slow) - audio.WINDOW + 1, audio.HOP):
            power = np.abs(np.fft.fft(np.append(slow[at : at + audio.WINDOW] * np.hanning(audio.WINDOW), np.zeros(56)))) ** 2
            rows = []
            for low, mid, high in zip(edges, edges[1:], edges[2:]):
                rows.append(sum(power[j] * max(0, min((f - low) / (mid - low), (high - f) / (high - mid))) for j in range(129) for f in [j * 8000 / 256]))
            frames.append([np.log(v + 1e-6) for v in rows])
        energy = [np.mean(f) for f in frames]
        opens, closes = np.mean(energy) + 0.5 * np.std(energy), np.mean(energy) - 0.5 * np.std(energy)
        found, start = [], None
        for k, e in enumerate([*energy, -np.inf]):
            if start is None and e > opens:
                start = k
            elif start is not None and e < closes:
                found.append((start, k))
                start = None
        assert np.allclose(spans, np.array(found) * 0.01)
        for own, (a, b) in zip(tensor, found, strict=True):
            cuts = np.linspace(a, b, audio.STEPS + 1).astype(int)
            want = [np.mean(frames[p : max(q, p + 1)], axis=0) for p, q in zip(cuts, cuts[1:])]
            assert np.allclose(own, want, atol=2e-3)

    def test_stored_tensors(self, spark, tmp_path):
        column = audio.tensor_array([np.zeros((2, audio.STEPS, audio.BANDS), np.float32)])
        assert column.type == pa.fixed_shape_tensor(pa.float32(), (audio.STEPS, audio.BANDS)) and len(column) == 2
        texts = {k: f"some text {k} " * (40 * k) for k in range(1, 40)} | {100: ""}
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        featured = audio.with_features(audio.store(docs), f"file://{tmp_path}/s")
        assert not list((tmp_path / "s").glob("*.part")) and featured.count() == 40
        featured.write.parquet(f"{tmp_path}/rows")
        featured = spark.read.parquet(f"{tmp_path}/rows")
        rows = {r.doc_id: r for r in featured.collect()}
        assert all(pa.ipc.open_file(r.file.removeprefix("file://")).schema.field("tensor").type == audio.TENSOR for r in rows.values())
        got: dict = {}
        for r in audio.read_segments(featured).collect():
            got.setdefault(r.doc_id, []).append(r)
        for k, text in texts.items():
            tensor, spans = audio.features(audio.encoded(audio.padded(text.encode())))
            own = got.get(k, [])
            assert [(r.start, r.end) for r in own] == [tuple(s) for s in spans.tolist()]
            assert np.array_equal(np.array([r.tensor for r in own], np.float32).reshape(tensor.shape), tensor)
            assert rows[k].feature == audio.digest(tensor, spans)

    def test_odd_rows(self, spark):
        rows = [(1, None), (2, ""), (3, "x" * 192), (4, "é" * 200_000), (5, "same"), (6, "same"), (None, "n")]
        docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, feature string")
        found = audio.with_features(audio.store(docs)).drop("file", "medium")
        got = {r.doc_id: r for r in found.collect()}
        assert len(got) == 7 and got[1][1:] == got[2][1:] and got[5][1:] == got[6][1:] and got[2].payload_bytes == got[3].payload_bytes == 192
        assert got[4].n_bytes == 400_000 and got[4].payload_bytes % 192 == 0
        assert audio.store(docs.limit(0)).count() == 0 == audio.with_features(audio.store(docs.limit(0))).count()
        with pytest.raises(ValueError):
            audio.decoded(b"RIFFnot a wav file")
