"""Media columns: audio features of texts stored as sound.

A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the samples of a mono 8-bit PCM WAV file
at 16 kHz. Features are made from the stored bytes: polyphase resampling to 8 kHz, overlapped log-mel filterbanks
(25 ms windows every 10 ms, 40 bands), and hysteresis segmentation by frame energy: a segment opens above the upper
level and runs until energy falls below the lower one. Each segment is summarised to a fixed (STEPS x BANDS) tensor
with its time span.

Segments are stored as an Arrow table in the shared folder: columns medium, start, end and tensor, the last of the
fixed-shape tensor type. A task writes an Arrow file of its own under a passing name and moves it to its final name when
complete; with_features() then reads the file back and names it in its rows, so attempts that were lost leave no file in
use. Files are opened through pyarrow's file systems, so the shared folder may be in any store that they reach.

Features are computed for each medium on its own, in blocks of BLOCK_FRAMES frames, so that equal texts have equal
values in any batch. A long text takes, beside itself, its table of energies, which is as large as the text, and a block.

Defined cases: null is the empty text, which is 192 spaces; a constant sound has one segment; equal rows get equal
values; an empty table gives no rows; a medium that is no such WAV file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from findloom.llm.common import new_path

RATE, UP, DOWN = 16_000, 1, 2
WINDOW, HOP, FFT, BANDS = 200, 80, 256, 40
STEPS = 4
UNIT, PAD = 192, b" "
BLOCK_FRAMES = 4096
#: Levels of hysteresis, in standard deviations of frame energy around its mean.
OPEN, CLOSE = 0.5, -0.5


def encoded(payload: bytes) -> bytes:
    """A WAV file whose 8-bit samples are the payload."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples_of(medium: bytes) -> memoryview:
    """The samples of a mono 8-bit WAV file, chunks before them skipped; no copy is made."""
    if medium[:4] != b"RIFF" or medium[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(medium):
        name, size = medium[at : at + 4], int.from_bytes(medium[at + 4 : at + 8], "little")
        if name == b"data":
            return memoryview(medium)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples in the WAV file")


def decoded(medium: bytes) -> bytes:
    return bytes(samples_of(medium))


def padded(text: bytes) -> bytes:
    return text + PAD * (UNIT - len(text) if len(text) < UNIT else -len(text) % UNIT)


def _lowpass(taps: int = 32) -> np.ndarray:
    n = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(taps)
    return (h / h.sum() * UP).astype(np.float32)


def _mel_bank() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triangular filters, evenly spaced on the mel scale up to half the new rate: (first bin of each stretch between edges, rise and fall of each bin in its stretch).

    Filter b rises over stretch b and falls over stretch b + 1. Summing by stretches instead of multiplying matrices
    gives the same bits whatever linear algebra library and number of threads there are.
    """
    rate = RATE * UP // DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), BANDS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    stretch = np.clip(np.searchsorted(edges, f, "right") - 1, 0, BANDS)
    rise = (f - edges[stretch]) / (edges[stretch + 1] - edges[stretch])
    return np.searchsorted(stretch, np.arange(BANDS + 2)), rise, 1 - rise


_TAPS, _BANK, _HANN = _lowpass(), _mel_bank(), np.hanning(WINDOW).astype(np.float32)


def resampled(samples: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
    """Outputs [start, end) of polyphase resampling of 8-bit samples, start a multiple of UP: the filter is cut into UP phases,
    each of which gives every UP-th output by strides over the samples that it needs. What lies outside the sound is silence."""
    taps = len(_TAPS)
    end = -(-len(samples) * UP // DOWN) if end is None else end
    # Output m is the sum of samples m * DOWN // UP - taps // 2 and on, by the taps of phase m * DOWN % UP.
    low, high = start * DOWN // UP - taps // 2, (end - 1) * DOWN // UP + taps + DOWN
    inside = samples[max(low, 0) : max(high, 0)]
    wide = np.zeros(high - low, np.float32)
    wide[max(-low, 0) : max(-low, 0) + len(inside)] = (inside.astype(np.float32) - 128) / 128
    out = np.zeros(end - start, np.float32)
    for residue in range(UP):
        own = out[residue::UP]
        first = (start + residue) * DOWN // UP - start * DOWN // UP
        for k, tap in enumerate(_TAPS[residue * DOWN % UP :: UP]):
            own += tap * wide[first + k : first + k + DOWN * len(own) : DOWN][: len(own)]
    return out


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x BANDS log filterbank energies of overlapped windows, mean of each frame) of 8-bit samples, a block of frames at a time.

    The table of energies has a number for each 4 samples; nothing else grows with the sound but a number a frame.
    """
    n = -(-len(samples) * UP // DOWN)
    frames = max(1, (n - WINDOW) // HOP + 1)
    out, energy = np.empty((frames, BANDS), np.float32), np.empty(frames)
    _, rise, fall = _BANK
    for at in range(0, frames, BLOCK_FRAMES):
        upto = min(at + BLOCK_FRAMES, frames)
        sound = resampled(samples, at * HOP, min((upto - 1) * HOP + WINDOW, n))
        if len(sound) < WINDOW:
            sound = np.concatenate((sound, np.zeros(WINDOW - len(sound), np.float32)))
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(sound, WINDOW)[::HOP] * _HANN, FFT)
        power = spectrum.real.astype(np.float64) ** 2 + spectrum.imag.astype(np.float64) ** 2
        out[at:upto] = np.log(_by_stretch(power * rise)[:, :-1] + _by_stretch(power * fall)[:, 1:] + 1e-6)
        energy[at:upto] = out[at:upto].mean(axis=1, dtype=np.float64)
    return out, energy


def _by_stretch(bins: np.ndarray) -> np.ndarray:
    """(frames x BANDS + 1) sums of the bins in each stretch."""
    first = _BANK[0]
    sums = np.add.reduceat(np.pad(bins, ((0, 0), (0, 1))), first[:-1], axis=1)
    sums[:, first[:-1] == first[1:]] = 0
    return sums


def segmented(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [start, end) of segments: opened at the upper level, held to the lower one."""
    spread = energy.std()
    if spread < 1e-9:
        return [(0, len(energy))]
    high, low = energy.mean() + OPEN * spread, energy.mean() + CLOSE * spread
    # State after each frame: that of the last frame which was above the upper or below the lower level.
    mark = np.where(energy > high, 1, np.where(energy < low, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)], -1) > 0
    edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _step_means(mel: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mean of mel[start:end] for each step of each segment; segments lie one after another."""
    out = np.empty((*start.shape, BANDS), np.float32)
    at = 0
    while at < len(start):
        # As many segments as lie in a few blocks of frames; a longer one is summed step by step.
        upto = max(at + 1, int(np.searchsorted(end[:, -1], start[at, 0] + 4 * BLOCK_FRAMES, "right")))
        low, high = start[at, 0], end[upto - 1, -1]
        if high - low <= 4 * BLOCK_FRAMES:
            sums = np.concatenate((np.zeros((1, BANDS)), np.cumsum(mel[low:high], axis=0, dtype=np.float64)))
            out[at:upto] = (sums[end[at:upto] - low] - sums[start[at:upto] - low]) / (end[at:upto] - start[at:upto])[..., None]
        else:
            out[at] = [mel[a:b].mean(axis=0, dtype=np.float64) for a, b in zip(start[at], end[at])]
        at = upto
    return out


def features(medium: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(segments x STEPS x BANDS tensor, segments x 2 time spans in seconds) of a stored medium."""
    mel, energy = log_mel(np.frombuffer(samples_of(medium), np.uint8))
    spans = segmented(energy)
    bounds = np.array([np.linspace(a, b, STEPS + 1).astype(np.int64) for a, b in spans]) if spans else np.zeros((0, STEPS + 1), np.int64)
    start, end = bounds[:, :-1], np.minimum(np.maximum(bounds[:, 1:], bounds[:, :-1] + 1), len(mel))
    tensor = _step_means(mel, np.minimum(start, end - 1), end)
    seconds = np.array(spans, np.float64).reshape(-1, 2) * HOP * DOWN / (RATE * UP)
    return tensor, seconds


def tensor_array(tensors: list[np.ndarray]) -> pa.ExtensionArray:
    """All segments as one Arrow fixed-shape tensor array."""
    whole = np.concatenate(tensors) if tensors else np.zeros((0, STEPS, BANDS), np.float32)
    kind = pa.fixed_shape_tensor(pa.float32(), (STEPS, BANDS))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), STEPS * BANDS)
    return pa.ExtensionArray.from_storage(kind, storage)


def store(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, medium (the WAV file)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                raw = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                media = pa.array([encoded(padded(t)) for t in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in raw], pa.int64()), media], ["doc_id", "n_bytes", "medium"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, medium binary")


TENSOR = pa.fixed_shape_tensor(pa.float32(), (STEPS, BANDS))
#: Of a table of segments: medium is the number of the file's medium that the segment is of.
STORED = pa.schema([("medium", pa.int64()), ("start", pa.float64()), ("end", pa.float64()), ("tensor", TENSOR)])


def segment_batch(first: int, made: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The segments of media numbered from first on, by their (tensor, spans)."""
    media = np.repeat(np.arange(first, first + len(made)), [len(t) for t, _ in made]) if made else np.zeros(0, np.int64)
    spans = np.concatenate([s for _, s in made]) if made else np.zeros((0, 2))
    return pa.RecordBatch.from_arrays([pa.array(media), pa.array(spans[:, 0]), pa.array(spans[:, 1]), tensor_array([t for t, _ in made])], schema=STORED)


def digest(tensor: np.ndarray, spans: np.ndarray) -> str:
    return f"{len(tensor)}:" + hashlib.sha256(np.round(tensor, 2).tobytes() + spans.tobytes()).hexdigest()[:32]


def stored_segments(path: str, store: pafs.FileSystem):
    """(tensor, spans) by medium, of each batch of a file of segments."""
    with store.open_input_file(path) as f, pa.ipc.open_file(f) as table:
        if not table.schema.equals(STORED):
            raise ValueError("not a table of segments")
        for k in range(table.num_record_batches):
            batch = table.get_batch(k)
            tensor = batch.column(3).to_numpy_ndarray() if batch.num_rows else np.zeros((0, STEPS, BANDS), np.float32)
            spans = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            media = batch.column(0).to_numpy()
            yield {m: (tensor[a:b], spans[a:b]) for m, a, b in zip(*_runs(media))}


def _runs(media: np.ndarray):
    """(medium, first row, end) of each medium in a sorted column."""
    named, first = np.unique(media, return_index=True)
    return named.tolist(), first.tolist(), [*first.tolist()[1:], len(media)]


def with_features(media: DataFrame, folder: str | None = None) -> DataFrame:
    """media(doc_id, n_bytes, medium) -> digests of the stored bytes read back, the features, and where they are stored.

    `feature` is the digest of a medium's tensors and spans as read back from the table of segments: the rows of `file`
    with that `medium` (read_segments() gives them).
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    folder = folder or new_path(media.sparkSession, "segments")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "file", "medium"]
    ddl = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, file string, medium long"

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"
        out, held, at = None, [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                made, rows = [], []
                for m in part.column(2):
                    medium = m.as_py()
                    payload = decoded(medium)
                    made.append(features(medium))
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(medium), hashlib.sha256(medium).hexdigest()))
                if out is None:
                    sink = store.open_output_stream(f"{root}/{name}.part", compression=None)
                    out = pa.ipc.new_file(sink, STORED, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                out.write_batch(segment_batch(at, made))
                held.append((part.column(0), part.column(1), rows, at))
                at += len(made)
        if out is None:
            return
        out.close()
        sink.close()
        store.move(f"{root}/{name}.part", f"{root}/{name}")
        none = (np.zeros((0, STEPS, BANDS), np.float32), np.zeros((0, 2)))
        for (ids, sizes, rows, first), found in zip(held, stored_segments(f"{root}/{name}", store), strict=True):
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            numbers = range(first, first + len(rows))
            own = pa.array([digest(*found.get(m, none)) for m in numbers], pa.string())
            yield pa.RecordBatch.from_arrays([ids, sizes, *columns, own, pa.array([f"{folder}/{name}"] * len(rows), pa.string()), pa.array(numbers, pa.int64())], names)

    return media.select("doc_id", "n_bytes", "medium").mapInArrow(run, ddl)


def read_segments(featured: DataFrame) -> DataFrame:
    """Rows of with_features() -> doc_id, start, end, tensor (STEPS x BANDS values, row by row) of each of their segments, from the stored tables."""
    kind = featured.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            wanted: dict[str, dict[int, int]] = {}
            for row, (file, medium) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                wanted.setdefault(file, {})[medium] = row
            for file, rows in wanted.items():
                store, path = pafs.FileSystem.from_uri(file)
                for found in stored_segments(path, store):
                    own = [(rows[m], t, s) for m, (t, s) in found.items() if m in rows]
                    ids = batch.column(0).take(pa.array(np.repeat([r for r, *_ in own], [len(t) for _, t, _ in own]).astype(np.int64)))
                    spans = np.concatenate([s for *_, s in own]) if own else np.zeros((0, 2))
                    tensors = pa.array([x.ravel() for _, t, _ in own for x in t], pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(spans[:, 0]), pa.array(spans[:, 1]), tensors], ["doc_id", "start", "end", "tensor"])

    chosen = featured.select("doc_id", "file", "medium").repartition("file").sortWithinPartitions("file", "medium")
    return chosen.mapInArrow(run, f"doc_id {kind}, start double, end double, tensor array<float>")
