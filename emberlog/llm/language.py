"""Languages of documents and of the segments of mixed documents.

String-kernel classification: two sentences are alike by the blended-spectrum presence kernel, the share of
character n-grams (1 to 3) that both contain, normalised by their numbers. Nystroem landmarks, sentences of a bounded
labelled sample, span the feature space, and one-versus-rest kernel ridge regression gives a score a language.

Scores of a batch are the product (presence matrix of the sentences) x (presence matrix of the landmarks)^T x
(coefficients). The last two factors do not depend on the batch and are multiplied once, into a row of scores for each
n-gram that any landmark has, so the batch costs one sparse product with as many columns as there are languages.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of sentences scored at once.
SLICE_CHARS = 120_000
CACHED_SENTENCES = 100_000
#: The bounded sample: documents drawn (in equal parts a language), sentences a document and a language used, landmarks a language.
SAMPLE_DOCS, SENTENCES_A_DOC, SENTENCES_A_LANGUAGE, LANDMARKS_A_LANGUAGE = 4000, 12, 240, 32
#: Longer documents are not drawn.
SAMPLE_CHARS = 20_000
#: Weight of a change of language between neighbouring sentences, in log odds, and the sharpness of the confidence.
SWITCH, SHARPNESS = 0.2, 9.0

_LINE = re.compile(r"\r\n|[\n\r\v\f\x85  ]")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>")
_LEAD = re.compile("[\\s﻿​>*•·+-]*(?:\\(?\\d{1,3}[.)]\\s+)?")
_CLOSED = re.compile("[.!?…。！？‼⁇][\"'”’»」』）)\\]*_\\s]*$")
_BREAK = re.compile("(?<=[.!?…])[\"'”’»)\\]]*\\s+|(?<=[。！？])[」』）\"'”]*\\s*")
_MACHINE_SIGN = re.compile(r"[0-9_\\/@=]")
#: A run of machine characters with a sign in it; tried only where such a run begins.
_MACHINE_RUN = re.compile(r"(?<![A-Za-z0-9_./\\:@%+=~#&?-])[A-Za-z.:%+~#&?-]*+[0-9_\\/@=][A-Za-z0-9_./\\:@%+=~#&?-]*+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_EAST = re.compile("[぀-ヿ㐀-鿿豈-﫿가-힯]")
_WORD = re.compile(r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*[.,;:!?…\"'”’»)\]]*")
ENDS = frozenset(".!?…。！？")
HEADING_WORDS, HEADING_CHARS = 8, 80


def plain_words(text: str) -> str:
    """Lower-case letters in words; machine parts (addresses, paths, numbers, identifiers), marks and signs are gone."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if _MACHINE_SIGN.search(text):
        text = _MACHINE_RUN.sub(" ", text)
    return _NOT_LETTERS.sub(" ", text).strip().lower()


def _is_machine(line: str) -> bool:
    """Log lines, code, hashes, addresses, links: hardly any of the tokens is a word."""
    tokens = line.split()
    if len(tokens) > 3 and line[-1] in ENDS and tokens[0][:1].isalpha() or not line.isascii() and _EAST.search(line):
        return False
    words = sum(1 for t in tokens if _WORD.fullmatch(t.lstrip("\"'“‘«(¿¡*_[")))
    return words * 3 < len(tokens)


def sentences(text: str | None) -> list[str]:
    """The sentences of a text in reading order, as plain words. Machine output and headings are left out: the former
    belongs to no segment, the latter takes the language of the text below it. Pieces of up to three letters, as
    abbreviations leave them, go with the sentence after them in their line, else with the one before; where there is
    none, they are a sentence."""
    out: list[str] = []
    short = ""
    fenced = False
    for line in _LINE.split(text or ""):
        if "<" in line:
            line = _MARKUP.sub(" ", line)
        line = line[_LEAD.match(line).end() :].rstrip()
        if not line:
            continue
        if line.startswith(("```", "~~~")):
            fenced = not fenced or line.count("```") > 1
            if line.count("```") > 1:
                fenced = False
            continue
        if fenced or _is_machine(line):
            continue
        if line[0] == "#" or line[-1] not in ENDS and not _CLOSED.search(line) and len(line) <= HEADING_CHARS and len(line.split()) <= HEADING_WORDS:
            continue
        for piece in _BREAK.split(line):
            words = plain_words(piece)
            if len(words) > 3 or words and _EAST.search(words):
                out.append(f"{short} {words}" if short else words)
                short = ""
            elif words:
                short = f"{short} {words}" if short else words
        if short and out:
            out[-1], short = f"{out[-1]} {short}", ""
    return out or ([short] if short else [])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, n-gram) of all n-grams of 1 to 3 characters, a space at either end; an n-gram is its code points in 63 bits."""
    cp = np.frombuffer((" " + " \x00 ".join(texts) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.cumsum(cp == 0)
    real = cp != 0
    two = real[:-1] & real[1:]
    three = two[:-1] & real[2:]
    pair = cp[:-1] | cp[1:] << 21
    return (
        np.concatenate([owner[real], owner[:-1][two], owner[:-2][three]]),
        np.concatenate([cp[real], pair[two], (pair[:-1] | cp[2:] << 42)[three]]),
    )


MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


class GramTable:
    """Exact n-gram -> row, by two direct-mapped tables: what does not fit the first goes to the second."""

    def __init__(self, keys: np.ndarray, bits: int = 17):
        while True:
            left, self.bits, self.slots = np.arange(len(keys)), bits, []
            for mix in MIX[:2]:
                slot, row = self._slot(keys[left], mix), np.full(1 << bits, -1, np.int32)
                row[slot] = left
                self.slots.append((row, np.where(row >= 0, keys[np.maximum(row, 0)], -1)))
                left = left[row[slot] != left]
            if not len(left):
                return
            bits += 1

    def _slot(self, keys: np.ndarray, mix: np.uint64) -> np.ndarray:
        return (keys.view(np.uint64) * mix >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        row, held = self.slots[0]
        slot = self._slot(keys, MIX[0])
        out = np.where(held[slot] == keys, row[slot], -1)
        left = np.flatnonzero(out < 0)
        row, held = self.slots[1]
        slot = self._slot(keys[left], MIX[1])
        out[left] = np.where(held[slot] == keys[left], row[slot], -1)
        return out.astype(np.int64)


def present(texts: list[str], table: GramTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, row) of the distinct n-grams in the table, sorted by text, and the number of all distinct n-grams a text."""
    owner, key = grams(texts)
    row = table.rows(key)
    unknown = (key.view(np.uint64) * MIX[2] >> np.uint64(26)).astype(np.int64) | 1 << 38
    both = np.sort(owner << 39 | np.where(row >= 0, row, unknown))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    owner, low = both >> 39, both & (1 << 39) - 1
    counts = np.bincount(owner, minlength=len(texts))
    known = low < 1 << 38
    return owner[known], low[known], counts


def summed(owner: np.ndarray, row: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The sparse product: for each text the sum of its rows of ``weights``."""
    out = np.zeros((n, weights.shape[1]), weights.dtype)
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] = np.add.reduceat(weights[row], first, axis=0)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    table: GramTable
    weights: np.ndarray  # a row for each n-gram of the landmarks

    def scores_cached(self, texts: list[str], cache: dict[str, np.ndarray]) -> np.ndarray:
        """``scores``, each distinct sentence once as long as the worker's cache holds it; it starts anew when full."""
        if len(cache) > CACHED_SENTENCES:
            cache.clear()
        new = [t for t in dict.fromkeys(texts) if t not in cache]
        cache.update(zip(new, self.scores(new)))
        return np.array([cache[t] for t in texts], np.float32).reshape(len(texts), len(self.languages))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.languages)), np.float32)
        owner, row, counts = present(texts, self.table)
        return summed(owner, row, self.weights, len(texts)) / np.sqrt(np.maximum(counts, 1))[:, None].astype(np.float32)

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], landmarks: int = LANDMARKS_A_LANGUAGE, ridge: float = 1e-3) -> LanguageModel:
        languages = sorted(set(labels))
        y = np.array([languages.index(x) for x in labels])
        marks = np.concatenate([own[np.linspace(0, len(own) - 1, min(landmarks, len(own))).astype(int)] for own in (np.flatnonzero(y == k) for k in range(len(languages)))])
        _, keys = grams([texts[i] for i in marks])
        vocabulary = np.unique(keys)
        table = GramTable(vocabulary)
        owner, row, counts = present([texts[i] for i in marks], table)
        basis = np.zeros((len(vocabulary), len(marks)), np.float32)
        basis[row, owner] = 1 / np.sqrt(counts[owner])
        kernel = []
        for a in range(0, len(texts), 200):
            o, r, c = present(texts[a : a + 200], table)
            dense = np.zeros((len(c), len(vocabulary)), np.float32)
            dense[o, r] = 1 / np.sqrt(c[o])
            kernel.append(dense @ basis)
        k_nm = np.concatenate(kernel).astype(np.float64)
        k_mm = k_nm[marks]
        values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-6))  # K_mm^(-1/2) up to a rotation
        phi = k_nm @ root
        share = np.bincount(y, minlength=len(languages))
        weight = (len(y) / len(languages) / share)[y]  # languages count alike
        target = np.where(np.arange(len(languages)) == y[:, None], 1.0, 0.0)
        gram = phi.T @ (phi * weight[:, None]) + ridge * len(y) * np.eye(phi.shape[1])
        coefficients = root @ np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
        return cls(languages, table, (basis @ coefficients.astype(np.float32)).astype(np.float32))


def normal_label(label: str | None, names: dict[str, str]) -> str | None:
    """The two-letter code a label means: a code or English name in any case, a region suffix and outer blanks allowed."""
    if label is None:
        return None
    text = label.strip().lower()
    return names.get(text) or names.get(re.split(r"[-_]", text)[0].strip())


def decode(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, confidence) of the sentences of one text: the path of greatest likelihood, changes of language weighed."""
    z = scores * SHARPNESS
    z = z - z.max(1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(1, keepdims=True))
    best = logs.argmax(1)
    if len(best) == 1 or (best == best[0]).all():
        path = best
    else:
        total, back = logs[0], []
        for row in logs[1:]:
            top = total.argmax()
            stay = total >= total[top] - SWITCH
            back.append(np.where(stay, np.arange(len(row)), top))
            total = np.where(stay, total, total[top] - SWITCH) + row
        path = [int(total.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = np.array(path[::-1])
    return path, np.exp(logs[np.arange(len(path)), path])


SEGMENT = pa.struct([("segment_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int64())])
LABELLED = "key long, label string, lang string, confidence double, status string, segments array<struct<segment_no: bigint, lang: string, confidence: double, sentences: bigint>>"


def _run(model: LanguageModel, names: dict[str, str]):
    def slices(keys, texts, labels):
        held, size = [], 0
        for k, t, label in zip(keys, texts, labels):
            own = sentences(t)
            held.append((k, label, own))
            size += sum(map(len, own))
            if size > SLICE_CHARS:
                yield held
                held, size = [], 0
        yield held

    def run(batches):
        cache: dict[str, np.ndarray] = {}
        for b in batches:
            for part in slices(*(b.column(c).to_pylist() for c in ("key", "text", "label"))):
                scores = model.scores_cached([s for _, _, own in part for s in own], cache) if model.languages else None
                at, out = 0, []
                for key, label, own in part:
                    known = normal_label(label, names)
                    if not own or not model.languages:
                        out.append((key, known, None, None, "no_sentence", []))
                        continue
                    path, sure = decode(scores[at : at + len(own)])
                    at += len(own)
                    cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
                    segments = [
                        {"segment_no": i, "lang": model.languages[path[x]], "confidence": float(sure[x:y].mean()), "sentences": y - x}
                        for i, (x, y) in enumerate(zip(cuts, cuts[1:]), 1)
                    ]
                    weight = np.bincount(path, weights=[len(s) for s in own])
                    main = int(weight.argmax())
                    lang = model.languages[main]
                    status = "mixed" if len(segments) > 1 else "missing" if known is None else "right" if known == lang else "wrong"
                    out.append((key, known, lang, float(sure[path == main].mean()), status, segments))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.list_(SEGMENT)))],
                        names=["key", "label", "lang", "confidence", "status", "segments"],
                    )

    return run


def label_names(codes: DataFrame) -> dict[str, str]:
    """Every accepted spelling, in lower case -> two-letter code; ``codes`` (lang, code3, english_name) has a row a language."""
    return {x.strip().lower(): r["lang"] for r in codes.select("lang", "code3", "english_name").collect() for x in r if x}


def chosen_sentences(said: dict[str, Counter]) -> tuple[list[str], list[str]]:
    """(sentences, languages) to fit on: a sentence met under several labels, as in documents labelled wrongly or
    written in several languages, has the label it is met under most; at most ``SENTENCES_A_LANGUAGE`` of each, the
    best attested first."""
    by_language: dict[str, list[tuple[int, str]]] = {}
    for text, labels in said.items():
        (label, n), *others = labels.most_common(2)
        if not others or n > others[0][1]:
            by_language.setdefault(label, []).append((n, text))
    best = {k: sorted(v, key=lambda x: (-x[0], x[1]))[:SENTENCES_A_LANGUAGE] for k, v in sorted(by_language.items())}
    return [t for v in best.values() for _, t in v], [k for k, v in best.items() for _ in v]


def fit_on_sample(docs: DataFrame, key: str, text: str, label: str, names: dict[str, str], sample_docs: int = SAMPLE_DOCS) -> LanguageModel | None:
    """Fit on about ``sample_docs`` labelled documents of at most ``SAMPLE_CHARS`` characters, at most ``SENTENCES_A_DOC`` sentences of each.

    Each language has an equal part of the sample, drawn from the whole table by the hash of the key: a first pass
    counts the labels, a second takes the documents whose hash is small enough. A language without labelled documents
    cannot be found and is warned of; null if there is none at all.
    """
    spelled = F.lower(F.trim(F.split(F.trim(label), "[-_]")[0]))
    counts = {r["s"]: r["count"] for r in docs.where(spelled.isin(list(names))).groupBy(spelled.alias("s")).count().collect()}  # one row a spelling
    total = Counter()
    for s, n in counts.items():
        total[names[s]] += n
    missing = sorted(set(names.values()) - set(total))
    if missing:
        warnings.warn(f"no document is labelled {', '.join(missing)}: these languages cannot be assigned", stacklevel=2)
    if not total:
        return None
    part = -(-sample_docs // len(total))
    share = F.lit(None)
    for s in sorted(counts):
        share = F.when(spelled == s, F.lit(min(1.0, 1.2 * part / total[names[s]]))).otherwise(share)
    place = F.xxhash64(key)
    drawn = docs.where(spelled.isin(list(counts)) & (F.pmod(place, F.lit(1_000_000)) < share * 1_000_000) & (F.length(text) <= SAMPLE_CHARS))
    rows, taken, said = drawn.select(place.alias("h"), spelled.alias("s"), F.col(text).alias("t")).collect(), Counter(), {}
    for r in sorted(rows, key=lambda r: (r["h"], r["t"])):
        lang = names[r["s"]]
        taken[lang] += 1
        if taken[lang] <= part:
            for x in sentences(r["t"])[:SENTENCES_A_DOC]:
                said.setdefault(x, Counter())[lang] += 1
    texts, labels = chosen_sentences(said)
    return LanguageModel.fit(texts, labels) if texts else None


def label_documents(docs: DataFrame, codes: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", model: LanguageModel | None = None) -> DataFrame:
    """(key, label, lang, confidence, status, segments): one row a document, every sentence of its whole text scored.

    ``lang`` is the language of most of the text, ``status`` right, wrong, missing (no label that means a language),
    mixed or no_sentence; ``segments`` are the longest stretches of sentences in one language. Null, empty and blank
    texts and those of machine output only have no sentence: lang null, no segments. Where no document has a usable
    label there is nothing to fit on, and all are so. Only the named columns are read; no shuffle.
    """
    names = label_names(codes)
    model = model or fit_on_sample(docs, key, text, label, names) or LanguageModel([], GramTable(np.zeros(1, np.int64)), np.zeros((1, 0), np.float32))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
    return rows.mapInArrow(_run(model, names), LABELLED).withColumnRenamed("key", key)


def segments_of(labelled: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row a segment of the documents whose label is missing or wrong or whose text is mixed."""
    cases = labelled.where(F.col("status").isin("missing", "wrong", "mixed"))
    return cases.select(key, F.explode("segments").alias("s")).select(key, F.col("s.segment_no").alias("segment_no"), F.col("s.lang").alias("segment_lang"), F.col("s.confidence").alias("confidence"))
