"""Abusive, hateful or sexual content by compression distance.

Two zstandard dictionaries are made, one of toxic and one of ordinary windows of labelled
documents. A window's score is what the toxic dictionary saves against the ordinary one, in
bytes for each byte (with ``SMOOTH`` more); a document's score is that of its worst window and
it is flagged above a threshold calibrated on labelled documents that were held out.

Windows are sentences or lines of the normalised text and, in longer ones, pieces of about
``PIECE`` characters that overlap by half; every part of a text is in a window. Normalising folds
case, accents, look-alike letters, digits for letters, letters set apart and repeated letters.

Labels are of whole documents and some are wrong, so training windows are sorted first: a
window of a toxic document counts as toxic if one of its word triples is at least ``LEAN`` times
as frequent in toxic documents as in clean ones, with enough evidence, and also more frequent
than in the background; such windows are left out of the ordinary side. Other windows of toxic documents whose
triples no clean document has and the background hardly are added, at the far end of the dictionary. Dictionaries hold whole windows, the most frequent nearest to the compressed text.

Copies of a text count once, with the label that most of its labelled copies have. All documents that
aren't fitted on serve as background. Their toxic share is estimated from phrases that labels alone make evident, and what
twice that share explains of a triple's documents doesn't count against it, so toxic content may be common.

Bounds (parameters): at most ``per_class`` labelled documents of each class are fitted on, those with the
least hashes of their ids, of those with at most ``windows_per_doc`` windows (a longer one is background); dictionaries of at most ``ORDINARY_BYTES``
and ``TOXIC_BYTES``. The background is counted over all documents. All documents are scored, whole, without a shuffle.
Windows are made once and written, compressed, to the shared checkpoint folder for both passes.

Dictionaries are content dictionaries: trained ones (segments chosen by the library from the same windows) gave an
F1 of 0.925 against 0.953 on held-out labels, since they cut windows into pieces.

Defined results for odd input: NULL and empty texts and single characters score 0 and are not flagged; a
document with both clean and toxic labels, or with none but unsure and NULL, isn't fitted on;
without toxic or without clean labels nothing is flagged and all scores are 0.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

SMOOTH, PIECE, LONG, SHORTEST, LEAN, EVIDENCE = 8, 48, 72, 2, 8.0, 7.0
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 1 << 20, 1 << 18, 15
TOXIC_LABELS = ("abusive", "hateful", "sexual")

#: Letters that look like Latin ones (fixed values).
ALIKE = str.maketrans(dict(zip("аеорсухіјѕԁһӏԛԝкмтвнгαεορτυικνβ", "aeopcyxijsdhlqwkmtbhraeoptuiknb", strict=True)))
#: Digits and signs that stand for letters (fixed values).
LEET = str.maketrans("013457@$", "oieastas")
UNSEEN = re.compile("[­​-‏ -‮⁠-⁤︀-️﻿]")
SPELT = re.compile(r"(?<![^\W_])(?:[^\W\d_][-.*_ ]){2,60}[^\W\d_](?![^\W_])")
REPEAT = re.compile(r"(.)\1{2,}")
SIGN = re.compile(r"[\d@$]")
NUMBER = re.compile(r"[a-z(=<>~≈#]{0,3}[\d:.,/%+\-–()]+|[\d:.,/%+\-–()]+[a-z]{0,2}|q5-[0-9a-f]+|[0-9a-f]{10,}")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")
LEAD = re.compile(r"^\s*(?:<[\w\-]+>|[>#*\-]+|\d+\.)\s*")


def _token(word: str) -> str:
    core = word.strip(".,;:!?()\"'`<>[]{}")
    if not core or NUMBER.fullmatch(core) or not re.search(r"[^\W\d_]", core):
        return "9"
    return word.translate(LEET)


def normalise(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = UNSEEN.sub("", unicodedata.normalize("NFKD", text))
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(ALIKE)
    text = SPELT.sub(lambda m: re.sub(r"[-.*_ ]", "", m.group(0)), text)
    if SIGN.search(text):
        text = " ".join([_token(w) if SIGN.search(w) else w for w in text.split()])
    return REPEAT.sub(r"\1", text)


def _pieces(sentence: str) -> tuple[str, ...]:
    one = " ".join(normalise(LEAD.sub("", sentence)).split())
    if len(one) < SHORTEST:
        return ()
    if len(one) <= LONG:
        return (one,)
    found, at = [], 0
    while True:
        end = min(at + PIECE, len(one))
        if end < len(one) and (space := one.rfind(" ", at + PIECE // 2, end)) >= 0:
            end = space
        found.append(one[at:end].strip())
        if end >= len(one):
            return tuple(found)
        # the next piece starts at a word within this one, so nothing lies between two pieces
        space = one.find(" ", at + PIECE // 2, end + 1)
        at = space + 1 if space >= 0 else at + PIECE // 2


_known_pieces = lru_cache(60_000)(_pieces)  # of sentences that recur


def windows(text: str | None) -> list[str]:
    """The different windows of a text."""
    return list(dict.fromkeys(w for s in SENTENCE.split(text or "") for w in (_known_pieces(s) if len(s) < 400 else _pieces(s))))


def _coder(content: bytes):  # noqa: ANN202
    import zstandard

    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=128, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0
    )
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


#: zstandard leaves inputs of some ten bytes as they are, so those shorter than BRIEF stand between two copies of
#: bytes that no text has, of which the second one always compresses.
BRIEF, FRAME = 32, bytes(range(14, 32))


def _gain(ordinary, toxic, window: bytes) -> float:  # noqa: ANN001
    """What the toxic dictionary saves against the ordinary one, for each byte; in a short window the first
    three bytes, as a name alone saves, don't count."""
    brief = len(window) < BRIEF
    data = FRAME + b"\n" + window + b"\n" + FRAME if brief else window
    saved = len(ordinary.compress(data)) - len(toxic.compress(data))
    if brief:
        saved = max(saved - 3, min(saved, 0))
    return saved / (len(window) + SMOOTH)


def dictionary(texts: Iterable[str], size: int, weak: Iterable[str] = ()) -> bytes:
    """Whole windows up to ``size`` bytes, the most frequent last and ``weak`` ones before all others; ties by the window."""
    held, total = [], 0
    for text, _ in [x for part in (texts, weak) for x in sorted(Counter(part).items(), key=lambda x: (-x[1], x[0]))]:
        data = text.encode() + b"\n"
        if total + len(data) > size:
            continue
        held.append(data)
        total += len(data)
    return b"".join(reversed(held)) or b"nothing.\n"


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: float

    def scorer(self):  # noqa: ANN201
        ordinary, toxic = _coder(self.ordinary), _coder(self.toxic)
        known: dict[str, float] = {}

        def one(window: str) -> float:
            score = known.get(window)
            if score is None:
                score = _gain(ordinary, toxic, window.encode())
                if len(known) < 100_000:
                    known[window] = score
            return score

        return lambda ws: max(map(one, ws), default=0.0)


def _grams(window: str) -> set[str]:
    words = window.split()
    grams = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)}
    if len(window) > 3 * max(1, len(words)) * 4:  # scripts without blanks
        grams |= {window[i : i + 5] for i in range(len(window) - 4)}
    return grams or {window}


def _counts(documents: list[list[str]]) -> Counter:
    return Counter(g for ws in documents for g in {g for w in ws for g in _grams(w)})


def _texts(rows: Iterable[tuple[int, bool, list[str]]]) -> list[tuple[int, bool, list[str]]]:
    """One row for each distinct text, under its first id: toxic by the majority of its copies (left out if even)."""
    copies: dict[tuple[str, ...], list[int]] = {}
    for i, toxic, ws in rows:
        copies.setdefault(tuple(ws), [i, 0, 0])[1 + toxic] += 1
    return [(i, yes > no, list(ws)) for ws, (i, no, yes) in copies.items() if yes != no]


def _dictionaries(clean: list[list[str]], toxic: list[list[str]], in_other: Mapping[str, int], n_other: int) -> tuple[bytes, bytes]:
    in_clean, in_toxic = map(_counts, (clean, toxic))
    n_clean, n_toxic = len(clean), len(toxic)

    def ratio(g: str, n: int) -> float:
        return (n / n_toxic) / ((in_clean[g] + 1) / n_clean)

    # toxic share of the background: how frequent phrases evident from labels alone are there, against toxic documents
    evident = [g for g, n in in_toxic.items() if n >= 3 and ratio(g, n) >= LEAN and n * np.log(ratio(g, n)) >= EVIDENCE]
    share = float(np.median([min(1.0, in_other.get(g, 0) * n_toxic / (max(1, n_other) * in_toxic[g])) for g in evident])) if evident else 0.0

    def rest(g: str, n: int) -> float:
        """Documents of the background that hold a triple, beyond twice those that its toxic share explains."""
        return max(0.0, in_other.get(g, 0) - 2 * share * n_other * n / n_toxic)

    def usual(g: str, n: int) -> float:
        return (n / n_toxic) / ((in_clean[g] + rest(g, n) + 1) / (n_clean + n_other))

    def leans(window: str, own: int) -> bool:
        """Whether a triple's rates in other toxic documents and in clean ones differ enough, by size and by evidence."""
        for g in _grams(window):
            n = in_toxic[g] - own
            if n >= 2 and ratio(g, n) >= LEAN and usual(g, n) >= LEAN * 3 / 4 and n * np.log(usual(g, n)) >= EVIDENCE:
                return True
        return False

    def rare(window: str) -> bool:
        """Whether no clean document has any of the triples, and the background each one less often than toxic documents."""
        return not any(in_clean[g] or rest(g, in_toxic[g]) * n_toxic * LEAN * 3 / 4 > in_toxic[g] * n_other for g in _grams(window))

    evident_windows = [w for ws in toxic for w in ws if leans(w, 1)]
    known = set(evident_windows)
    weak = [w for ws in toxic for w in ws if w not in known and rare(w)]
    return dictionary((w for ws in clean for w in ws if not leans(w, 0)), ORDINARY_BYTES), dictionary(evident_windows, TOXIC_BYTES, weak)


#: Toxic documents that the usual threshold counts for beside those held out.
PRIOR = 10


def fit(labelled: list[tuple[int, bool, list[str]]], in_other: Mapping[str, int], n_other: int) -> Model:
    """From different texts (id, toxic, windows) and the background's document counts: the threshold on a
    held-out third, the dictionaries on all."""
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 0
    part = lambda toxic, keep: [w for i, t, w in labelled if t == toxic and keep(i)]
    if not part(True, lambda i: True) or not part(False, lambda i: True):
        return Model(b"nothing.\n", b"nothing.\n", float("inf"))
    threshold = 0.1
    fitted = [part(t, lambda i: not held(i)) for t in (False, True)]
    if all(fitted):
        ordinary, toxic = map(_coder, _dictionaries(*fitted, in_other, n_other))
        seen = [(max((_gain(ordinary, toxic, w.encode()) for w in ws), default=0.0), t) for i, t, ws in labelled if held(i)]
        scores, truth = np.array([s for s, _ in seen]), np.array([t for _, t in seen], bool)
        grid = np.arange(-0.05, 0.5, 0.005)
        f1 = np.array([2 * (truth & (scores > t)).sum() / max(1, truth.sum() + (scores > t).sum()) for t in grid])
        best = float(grid[f1 >= f1.max() - 0.002].mean()) if len(scores) else threshold
        # the best threshold weighs as many documents as were held out, the usual one PRIOR; a text without windows scores 0
        threshold = max(0.01, (truth.sum() * best + PRIOR * threshold) / (truth.sum() + PRIOR))
    return Model(*_dictionaries(part(False, lambda i: True), part(True, lambda i: True), in_other, n_other), threshold)


def prepared(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, packed): the windows of every text, made once and written compressed; NULL for a NULL text."""
    import zstandard

    kept = [documents.schema[c] for c in keep]
    schema = ", ".join(["doc_id bigint", *[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "packed binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            made = [None if t is None else pack("\n".join(windows(t)).encode()) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=["doc_id", *keep, "packed"])

    return cut_lineage(documents.select("doc_id", *keep, "text").mapInArrow(run, schema))


def _unpack():  # noqa: ANN202
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return lambda packed: [w for w in open_(packed).decode().split("\n") if w] if packed else []


def background(texts: DataFrame, fitted: Iterable[int], grams: Iterable[str]) -> tuple[dict[str, int], int]:
    """How many different texts hold each of ``grams``, and how many there are, over all ``prepared`` ones but the ``fitted`` ones.

    One pass and a shuffle of (hash of the windows, numbers of grams); both arguments are bounded by the sample."""
    names = sorted(grams)
    shared = texts.sparkSession.sparkContext.broadcast((frozenset(fitted), {g: k for k, g in enumerate(names)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out, number = shared.value
        unpack, met = _unpack(), {}  # met: of windows that recur

        def numbers(window: str) -> list[int]:
            got = met.get(window)
            if got is None:
                got = [number[g] for g in _grams(window) if g in number]
                if len(met) < 60_000:
                    met[window] = got
            return got

        for batch in batches:
            copies, held = [], []
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i not in left_out:
                    copies.append(int.from_bytes(blake2b(packed, digest_size=8).digest(), "big", signed=True))
                    held.append([-1, *{k for w in unpack(packed) for k in numbers(w)}])  # -1 counts the texts
            yield pa.RecordBatch.from_arrays([pa.array(copies, pa.int64()), pa.array(held, pa.list_(pa.int32()))], names=["copy", "held"])

    distinct = texts.where("packed is not null").select("doc_id", "packed").mapInArrow(run, "copy bigint, held array<int>").groupBy("copy").agg(F.first("held").alias("held"))
    counts = {r.gram: r.n for r in distinct.select(F.explode("held").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    n = counts.pop(-1, 0)
    return {names[k]: c for k, c in counts.items()}, n


def train(texts: DataFrame, labels: DataFrame, *, per_class: int = 6000, windows_per_doc: int = 1000) -> Model:
    """Fit on a bounded sample of the labelled ``prepared`` texts against all others."""
    toxic = F.col("label").isin(*TOXIC_LABELS)
    known = (
        labels.where(F.col("doc_id").isNotNull() & (toxic | (F.col("label") == "clean")))
        .groupBy("doc_id").agg(F.max(toxic).alias("toxic"), F.min(toxic).alias("all_toxic")).where("toxic = all_toxic")
    )
    sample = None
    for kind in (False, True):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "toxic")
        sample = part if sample is None else sample.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpack()
        for batch in batches:
            made = [unpack(x) for x in batch.column(1).to_pylist()]
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.list_(pa.string()))], names=["doc_id", "toxic", "windows"])
            yield rows.filter(pa.array([len(ws) <= windows_per_doc for ws in made], pa.bool_()))

    # at most 2 * per_class rows of two columns: bounded by the parameter
    labelled_texts = texts.where("packed is not null and doc_id is not null").select("doc_id", "packed").join(F.broadcast(sample), "doc_id").select("doc_id", "packed", "toxic")
    rows = labelled_texts.mapInArrow(run, "doc_id bigint, toxic boolean, windows array<string>").collect()
    labelled = _texts(sorted(((r.doc_id, r.toxic, r.windows) for r in rows), key=lambda x: (x[0], str(x[1]))))
    if len({t for _, t, _ in labelled}) < 2:
        return fit(labelled, {}, 0)
    grams = {g for _, t, ws in labelled if t for w in ws for g in _grams(w)}
    return fit(labelled, *background(texts, [r.doc_id for r in rows], grams))


def scores(texts: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, score, flagged) of every one of the ``prepared`` texts."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded by the dictionaries' sizes
    kept = [texts.schema[c] for c in keep]
    schema = ", ".join(["doc_id bigint", *[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "score double, flagged boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, unpack = shared.value.scorer(), _unpack()
        limit = shared.value.threshold
        for batch in batches:
            got = np.array([score(unpack(x)) for x in batch.column(batch.num_columns - 1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got), pa.array(got > limit)], names=["doc_id", *keep, "score", "flagged"])

    return texts.select("doc_id", *keep, "packed").mapInArrow(run, schema)
