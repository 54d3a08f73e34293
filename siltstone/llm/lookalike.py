"""One form for texts that look the same but differ in their characters.

A batch of texts is one array of code points. A lookup table gives for every code point how
many code points replace it and where they lie: none for invisible characters, a space for
every kind of space, the usual letter for full-width forms and look-alike letters, letter and
marks for accented letters. Gathers with expansion offsets replace the whole batch at once;
then marks are put in canonical order and composed, again over whole arrays.

The form is for comparing: look-alike letters of other scripts become Latin ones everywhere,
also within words of those scripts. Case, punctuation, accents, line ends and the number of
spaces stay; raised and circled digits, ligatures and styled letters are not full-width
forms and stay.

Defined results: null stays null; empty, or made of invisible characters only, becomes "".
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_batches
from siltstone.session import written

# Letters of other scripts beside the Latin letters that they look like.
LATIN = "aceopxysijdhqwl" "ABEKMHOPCTXYSIJQWG" "aovipcj" "ABEZHIKMNOPTYXCJF" "ogOSLhuU"
OTHER = "асеорхуѕіјԁһԛԝӏ" "АВЕКМНОРСТХУЅІЈԚԜԌ" "αονιρϲϳ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϜ" "օցՕՏԼհսՍ"
SPACES = [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]
_INVISIBLE = frozenset(INVISIBLE)
TOP = 0x110000


@functools.lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(count, start, replacement) of each code point, its combining class, and the keys and values of composition."""
    alike = {ord(o): ord(x) for x, o in zip(LATIN, OTHER, strict=True)}
    into: dict[int, list[int]] = {}
    pairs: dict[int, int] = {}
    ccc = np.zeros(TOP, np.uint8)
    for cp in [*range(0xA0, 0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]:
        c = chr(cp)
        ccc[cp] = unicodedata.combining(c)
        d = unicodedata.decomposition(c)
        if d.startswith(("<wide>", "<narrow>")):
            c = unicodedata.normalize("NFKC", c) if d.startswith("<wide>") or cp < 0xFF61 or cp > 0xFFDC else c
        elif d and not d.startswith("<"):
            two = unicodedata.normalize("NFD", c)
            parts = [int(x, 16) for x in d.split()]
            if len(parts) == 2 and unicodedata.normalize("NFC", c) == c:
                pairs[parts[0] << 32 | parts[1]] = cp
            into[cp] = [alike.get(ord(x), ord(x)) for x in two]
            continue
        out = [alike.get(ord(x), ord(x)) for x in unicodedata.normalize("NFD", c)]
        if out != [cp]:
            into[cp] = out
    into |= {cp: [0x20] for cp in SPACES} | {cp: [] for cp in INVISIBLE}
    count, start = np.ones(TOP, np.uint8), np.zeros(TOP, np.int64)
    flat = [*range(TOP)]
    start[:] = np.arange(TOP)
    for cp, out in into.items():
        count[cp], start[cp] = len(out), len(flat)
        flat += out
    keys = np.array(sorted(pairs), np.uint64)
    return count, start, np.array(flat, np.uint32), ccc, keys, np.array([pairs[int(k)] for k in keys], np.uint32)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one array, and where each begins, ending with the total. Null counts as empty."""
    texts = texts.cast(pa.large_utf8()) if texts.type != pa.large_utf8() else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32), lead[offsets - offsets[0]]


def one_form(cps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count, start, flat, ccc, keys, values = tables()
    # Replace: the i-th output of a code point lies i behind its start.
    n = count[cps].astype(np.int64)
    after = np.concatenate([[0], np.cumsum(n)])
    out = flat[np.arange(after[-1]) - np.repeat(after[:-1], n) + np.repeat(start[cps], n)]
    ends = after[ends]
    # Order: marks between two letters, within a text, by their class, stably; letters have class 0.
    cls = ccc[out]
    if cls.any():
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        first = np.ones(len(out), bool)
        first[1:] = text[1:] != text[:-1]
        if ((cls[1:] > 0) & (cls[:-1] > cls[1:])).any():
            order = np.lexsort((cls, np.cumsum((cls == 0) | first)))  # lexsort is stable
            out, cls = out[order], cls[order]
        # Compose: a letter and the first mark behind it that isn't blocked by another of its class become one, until none are left.
        at = np.arange(len(out))
        while True:
            base = np.maximum.accumulate(np.where(cls == 0, at, -1))
            i = np.flatnonzero((cls > 0) & (base >= 0))
            i = i[text[base[i]] == text[i]]
            i = i[(base[i] == i - 1) | (cls[i - 1] < cls[i])]
            key = out[base[i]].astype(np.uint64) << np.uint64(32) | out[i].astype(np.uint64)
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[where] == key
            if not hit.any():
                break
            i, where = i[hit], where[hit]
            _, one = np.unique(base[i], return_index=True)
            i, where = i[one], where[one]
            out[base[i]] = values[where]
            keep = np.ones(len(out), bool)
            keep[i] = False
            out, text, cls = out[keep], text[keep], cls[keep]
            at = at[: len(out)]
        ends = np.searchsorted(text, np.arange(len(ends)))
    return _syllables(out, ends)


def _syllables(out: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining jamo as syllables: two or three in a row become one."""
    lead = (out >= 0x1100) & (out <= 0x1112)
    if not lead.any():
        return out, ends
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    for low, high, base in ((0x1161, 0x1175, True), (0x11A8, 0x11C2, False)):
        i = np.flatnonzero((out[1:] >= low) & (out[1:] <= high) & (text[1:] == text[:-1]))
        first = out[i].astype(np.int64)
        if base:
            i = i[(first >= 0x1100) & (first <= 0x1112)]
            out[i] = 0xAC00 + ((out[i] - 0x1100) * 21 + (out[i + 1] - low)) * 28
        else:
            i = i[(first >= 0xAC00) & (first <= 0xD7A3) & ((first - 0xAC00) % 28 == 0)]
            out[i] += out[i + 1] - (low - 1)
        keep = np.ones(len(out), bool)
        keep[i + 1] = False
        out, text = out[keep], text[keep]
    return out, np.searchsorted(text, np.arange(len(ends)))


def texts(cps: np.ndarray, ends: np.ndarray, null: pa.Array | None) -> pa.Array:
    """The inverse of code_points."""
    raw = cps.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    width = 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(width)])[ends].astype(np.int64)
    mask = None
    if null is not None and null.null_count:
        mask = pa.array(np.asarray(null.is_valid())).buffers()[1]
    return pa.Array.from_buffers(pa.large_utf8(), len(ends) - 1, [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]).cast(pa.utf8())


def normalise(t: pa.Array) -> pa.Array:
    cps, ends = code_points(t)
    return texts(*one_form(cps, ends), t)


def normalised(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form): every text in its one form; no shuffle."""
    src = documents.select(key, text)

    def make():  # noqa: ANN202
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), normalise(b.column(1))], names=[key, "form"])

        return batch

    return map_batches(src, make, f"{key} {src.schema[key].dataType.simpleString()}, form string")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, raw, form): 128-bit fingerprints of a text as written and of its one form; null and empty texts have none."""
    src = documents.select(key, text, F.unhex(F.md5(F.col(text).cast("binary"))).alias("raw")).where(F.length(text) > 0)

    def make():  # noqa: ANN202
        import hashlib

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            cps, ends = one_form(*code_points(b.column(1)))
            form = [hashlib.blake2b(cps[s:e].tobytes(), digest_size=16).digest() for s, e in zip(ends[:-1], ends[1:])]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(form, pa.binary())], names=[key, "raw", "form"])

        return batch

    return map_batches(src, make, f"{key} {src.schema[key].dataType.simpleString()}, raw binary, form binary")


def look_alike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(form, raw, copies, least): the spellings of each text that has several, with how often each occurs.

    Exact copies are counted before the shuffle, so a text that makes up a third of all rows
    is one row for each task.
    """
    spell = fingerprints(documents, key, text).groupBy("form", "raw").agg(F.count("*").alias("copies"), F.min(key).alias("least"))
    several = spell.groupBy("form").agg(F.count("*").alias("n")).where("n > 1")
    return spell.join(several.select("form"), "form", "left_semi")


def look_alike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b): the smaller key first; two documents whose texts differ but have one form.

    Only documents whose form has several spellings are joined; exact copies of one text aren't
    paired with each other. The fingerprints are a written table, so texts are read once.
    """
    m = _twins(documents, key, text)
    a, b = m.select("form", F.col(key).alias("doc_a"), F.col("raw").alias("ra")), m.select("form", F.col(key).alias("doc_b"), F.col("raw").alias("rb"))
    return a.join(b, "form").where("doc_a < doc_b and ra <> rb").select("doc_a", "doc_b").distinct()


def _twins(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, raw, form) of the documents whose form has several spellings."""
    marks = written(fingerprints(documents, key, text), "fingerprints")
    several = marks.groupBy("form").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("form")
    return marks.join(several, "form", "left_semi")


def look_alike_members(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class, spellings, links): one row for each document that has a twin; copies aren't expanded into pairs.

    class is the least key of the form, links the number of pairs that the document is in.
    """
    m = _twins(documents, key, text)
    spell = m.groupBy("form", "raw").agg(F.count("*").alias("copies"), F.min(key).alias("least"))
    form = spell.groupBy("form").agg(F.sum("copies").alias("n"), F.count("*").alias("spellings"), F.min("least").alias("class"))
    each = spell.join(form, "form").select("form", "raw", "class", "spellings", (F.col("n") - F.col("copies")).alias("links"))
    return m.join(each, ["form", "raw"]).select(key, "class", "spellings", "links")


def pairs_sql() -> str:
    """The same pairs in SQL: composed, translated and composed again, by lists made from the Unicode data alone."""
    alike = str.maketrans(OTHER, LATIN)
    old = new = ""
    for cp in range(0x80, 0xF0000):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000 or cp in _INVISIBLE or cp in SPACES:
            continue
        wide = unicodedata.decomposition(c).startswith("<wide>") or unicodedata.decomposition(c).startswith("<narrow>") and not 0xFF61 <= cp <= 0xFFDC
        to = unicodedata.normalize("NFC", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c) if wide else c).translate(alike))
        if len(to) == 1 and to != c:
            old, new = old + c, new + to
    old, new = old + "".join(map(chr, SPACES[1:])), new + " " * (len(SPACES) - 1)
    old += "".join(map(chr, INVISIBLE))
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"""WITH d AS (SELECT doc_id, text, nfc_normalize(translate(nfc_normalize(text), {quoted(old)}, {quoted(new)})) AS form FROM documents WHERE length(text) > 0)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"""
