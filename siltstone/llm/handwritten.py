"""Telling hand-written source from generated, minified, vendored and data files.

A linear support-vector classifier over hashed features decides by its margin alone: the
character n-grams of the body as shares of the file, those of the body with names and numbers
masked, those of the head comment by their presence, and the components of the path.

It is fitted on a bounded sample. A file of it counts as not hand-written if its head names a
generator or an upstream release, if its body has the shape of shrunk code, of literals or of
one line repeated, or if its body occurs in several projects or mostly with such a head. Those
rules give labels only; no row comes out by them. Each file of the sample is learnt twice, once with its head comment
masked, so giveaway headers don't stand in for bodies and paths, and files of the same kind
without a header are found by these. Whole projects are held out to choose the threshold and
to measure, with heads seen and with heads masked.

Copies lose their headers, so an exact check follows: a body of which at least half the files
are over the threshold takes its other files along.

Only the fit is bounded: by SAMPLE rows, those of the smallest hashes of their keys, without
files of more than SAMPLE_BYTES, and by SAMPLE_TOTAL bytes in all. Every row is scored, over its whole content.

Defined results: null content is no case, and neither are other extensions; blank files are
hand-written; of several deliveries of one key the last one counts; a null key is no record;
a null path has no components. If the sample has no file of one of the two sorts, nothing is
found.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import syntax
from siltstone.llm.common import map_batches

SAMPLE, SAMPLE_BYTES, SAMPLE_TOTAL = 6000, 32_768, 24_000_000
#: Shorter bodies give no label by being the same in several projects.
LABEL_BYTES = 200
BITS = 17
#: Lengths of the n-grams of bodies, of masked bodies and of head comments.
BODY_GRAMS, FORM_GRAMS, HEAD_GRAMS = (3, 5), (3, 5, 9), (4, 6)
#: Values of a whole body, of an n-gram of a head, of a path component.
BODY_SCALE, HEAD_SCALE, PATH_SCALE = 40.0, 0.3, 1.0
#: The parts of the weights.
BODY, FORM, PATH, HEAD = range(4)
LANGUAGES = frozenset("python javascript typescript java go rust c".split())
EPOCHS, PENALTY = 12, 1e-4
PIECE = 1 << 20
#: The threshold: the least margin at which so many of the held-out files found are of the sort, but LEAST at least.
PRECISE, LEAST = 0.97, 0.0
PRIMES = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)

_HEAD = re.compile(rb"(?:\xef\xbb\xbf)?(?:#![^\n]*\n)?(?:\s*(?://[^\n]*|#(?!\s*(?:include|define|if|ifdef|ifndef|pragma|undef|error)\b)(?!\[)(?!!\[)[^\n]*|/\*[\s\S]*?\*/))*\s*")
# What the head comment of a generated file and of a third-party copy says.
_GENERATED = re.compile(
    rb"@generated\b|<auto-?generated|\bauto-?(?:matically[ -])?generated\b|\bcode generated\b|\bgenerated (?:by|from|with|using|at|on|file|code|source)\b|\bdo not (?:edit|modify|change)\b|\bmachine[ -](?:made|generated|written)\b"
    rb"|\b(?:produced|created|built|emitted|written) (?:automatically|by (?:a )?(?:tool|generator|script))\b|nicht von hand|automatisch (?:erzeugt|generiert)|\bg\xc3\xa9n\xc3\xa9r\xc3\xa9 (?:par|automatiquement)|\bne pas modifier\b|\bgenerado (?:por|autom)|\bno (?:editar|modificar)\b|\bgerado (?:por|autom)"
    rb"|\xd1\x81\xd0\xb3\xd0\xb5\xd0\xbd\xd0\xb5\xd1\x80\xd0\xb8\xd1\x80\xd0\xbe\xd0\xb2\xd0\xb0\xd0\xbd|\xe8\x87\xaa\xe5\x8a\xa8\xe7\x94\x9f\xe6\x88\x90|\xe8\xaf\xb7\xe5\x8b\xbf\xe7\xbc\x96\xe8\xbe\x91",
    re.I,
)
_UPSTREAM = re.compile(
    rb"@preserve\b|\bupstream (?:release|version|source|url)\s*:|\bvendored (?:from|copy)\b|\borigin:\s*\S+ (?:release|version|v?\d)|\bcopied (?:verbatim )?from\s+\S+ v?\d+\.\d|[\w.-]+ v?\d+\.\d+(?:\.\d+)? \| [^\n]{0,60}licen[cs]e|@license\b[^\n]{0,40}\d+\.\d|\bthird[- ]party (?:code|copy|source|library)\b",
    re.I,
)
_SPLIT = re.compile(r"[/\\]+")
_PART = re.compile(r"[A-Z]?[a-z]+|\d+|[A-Z]+")
_HEX = re.compile(rb"(?:0x[0-9a-fA-F]{1,8}|-?\b\d{1,10}(?:\.\d+)?)\s*,|[\"'][A-Za-z0-9+/=_-]{40,}[\"']")


_NAME = re.compile(rb"[A-Za-z0-9_]+")
_MARKS = re.compile(rb"[\s*#/]+")
_WORDS, _NUMBERS = re.compile(rb"w[w0]+"), re.compile(rb"0[0w.]+")
_CLASSES = bytes(ord("w") if c >= 128 or c == 95 or chr(c).isalpha() else ord("0") if chr(c).isdigit() else c for c in range(256))
_LITERAL = re.compile(rb"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b0[xX][0-9a-fA-F]+\b|\b\d[\d.]*(?:[eE][+-]?\d+)?\b")
_NO_LETTERS = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalpha())


def shape(body: bytes) -> str:
    """min for shrunk code, data for a block of literals, list for declarations alike but for names and numbers, "" for anything else."""
    n = len(body)
    lines = body.count(b"\n") + 1
    if lines >= 10:
        # The masked form of a line: names and numbers are one letter. Runs of one form of call or record are counted.
        forms = [x for x in _NAME.sub(b"w", body).split(b"\n") if x.strip()]
        run = most = 1
        for a, b in zip(forms, forms[1:]):
            run = run + 1 if a == b and b"w" in b and len(b) > 12 and (b"(" in b or b"{" in b) else 1
            most = max(most, run)
        if most >= 8 and most > 0.3 * len(forms):
            return "list"
    blanks = body.count(b" ") + body.count(b"\t") + lines
    if body.count(b",") > n / 80:
        # Words outside of strings are what code is made of.
        rest, count = _LITERAL.subn(b"", body)
        if count >= 20 and len(rest.translate(None, _NO_LETTERS)) < 0.06 * n:
            return "data"
    if (literal := sum(len(m) for m in _HEX.findall(body))) > 0.6 * (n - blanks) and literal > 120:
        return "data"
    return "min" if n / lines > 200 and blanks < 0.09 * n and body.count(b";") + body.count(b",") > n / 80 else ""


def split(content: bytes) -> tuple[bytes, bytes]:
    """(head comment, body)."""
    m = _HEAD.match(content)
    end = m.end() if m else 0
    return content[:end], content[end:]


def label(content: bytes) -> str:
    """"gen" or "lib" by the head comment, else the shape of the body: what the classifier is fitted on."""
    head, body = split(content)
    # Lines of the head are joined, so a sentence may go over lines.
    flat = _MARKS.sub(b" ", head)
    if _GENERATED.search(head) or _GENERATED.search(flat):
        return "gen"
    return "lib" if _UPSTREAM.search(head) or _UPSTREAM.search(flat) else shape(body)


def components(path: str | None) -> list[int]:
    """Hashed components: folders, folders in order, endings and last words of the name."""
    if not path:
        return []
    parts = [x for x in _SPLIT.split(path) if x not in ("", ".")]
    folders, name = parts[:-1], parts[-1]
    stem, *ends = name.split(".")
    words = [w.lower() for w in _PART.findall(stem)]
    out = [f"d:{x}" for x in folders] + [f"t:{x}" for x in folders[:1]] + [f"p:{'/'.join(folders[i : i + 2])}" for i in range(len(folders) - 1)]
    out += [f"e:{'.'.join(ends)}"] + [f"x:{x}" for x in ends[:-1]] + ([f"w:{words[-1]}", f"u:{stem.rpartition('_')[2]}"] if words else []) + (["_-"] if stem[:1] == "_" else [])
    return [zlib.crc32(x.encode()) & (1 << BITS) - 1 for x in dict.fromkeys(out)]


def form(body: bytes) -> bytes:
    """body with each name as one w and each number as one 0."""
    return _NUMBERS.sub(b"0", _WORDS.sub(b"w", body.translate(_CLASSES)))


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The hashed n-gram that begins at each byte; the last n - 1 bytes begin none."""
    if len(data) < n:
        return np.empty(0, np.uint32)
    x = data.astype(np.uint32)
    h = np.full(len(x) - n + 1, n, np.uint32)
    for i in range(n):
        h *= np.uint32(16777619)
        h += x[i : len(x) - n + 1 + i] * PRIMES[i % len(PRIMES)]
    return (h ^ h >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(32 - BITS)


def head_grams(head: bytes) -> np.ndarray:
    """The hashed n-grams of a head comment, each once; marks and line ends are blanks."""
    if not head:
        return np.empty(0, np.uint32)
    data = np.frombuffer(_MARKS.sub(b" ", head).lower(), np.uint8)
    return np.unique(np.concatenate([grams(data, n) for n in HEAD_GRAMS]))


@dataclass
class Model:
    """weights (part, hash)."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.0

    def scores(self, contents: list[bytes], paths: list[str | None]) -> tuple[np.ndarray, list[bytes]]:
        """The margins over the threshold of a batch, and its bodies; over whole files, PIECE bytes or one file at a time, to bound the memory."""
        parts = [split(c) for c in contents]
        out, start, size = [], 0, 0
        for i, c in enumerate(contents):
            if i > start and size + len(c) > PIECE:
                out.append(self._scores(parts[start:i], paths[start:i]))
                start, size = i, 0
            size += len(c)
        return np.concatenate([*out, self._scores(parts[start:], paths[start:])]) - self.threshold, [b for _, b in parts]

    def _scores(self, parts: list[tuple[bytes, bytes]], paths: list[str | None]) -> np.ndarray:
        out = np.full(len(parts), self.bias)
        bodies = [b for _, b in parts]
        self._add(out, BODY, BODY_GRAMS, bodies)
        self._add(out, FORM, FORM_GRAMS, [form(b) for b in bodies])
        heads, path = self.weights[HEAD], self.weights[PATH]
        for i, ((head, _), p) in enumerate(zip(parts, paths)):
            if head:
                out[i] += heads[head_grams(head)].sum() * HEAD_SCALE
            for c in components(p):
                out[i] += path[c] * PATH_SCALE
        return out

    def _add(self, out: np.ndarray, part: int, lengths: tuple[int, ...], texts: list[bytes]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(sizes)
        for n in lengths:
            h = grams(data, n)
            if not len(h):
                continue
            total = np.concatenate([[0.0], np.cumsum(self.weights[part][h], dtype=np.float64)])
            some = np.flatnonzero(sizes >= n)
            first, last = (ends - sizes)[some], ends[some] - n + 1
            out[some] += (total[last] - total[first]) / (last - first) * BODY_SCALE


Row = tuple[np.ndarray, np.ndarray]


def sparse(content: bytes, path: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, values, how many of them are left if the head is masked) of one file."""
    head, body = split(content)
    ids, values = [], []
    for part, lengths, text in ((BODY, BODY_GRAMS, body), (FORM, FORM_GRAMS, form(body))):
        for n in lengths:
            h = grams(np.frombuffer(text, np.uint8), n)
            if len(h):
                u, c = np.unique(h, return_counts=True)
                ids.append(u.astype(np.int32) + np.int32(part << BITS))
                values.append(c.astype(np.float32) * np.float32(BODY_SCALE / len(h)))
    p = np.array(components(path), np.int32) + np.int32(PATH << BITS)
    h = head_grams(head).astype(np.int32) + np.int32(HEAD << BITS)
    ids += [p, h]
    values += [np.full(len(p), PATH_SCALE, np.float32), np.full(len(h), HEAD_SCALE, np.float32)]
    return np.concatenate(ids), np.concatenate(values), sum(map(len, ids)) - len(h)


def fit(rows: list[Row], labels: np.ndarray, epochs: int = EPOCHS, penalty: float = PENALTY, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support-vector classifier: hinge loss, subgradient steps, the mean of the later epochs."""
    w, total = np.zeros(4 << BITS), np.zeros(4 << BITS)
    b = total_b = 0.0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = 0.05 / (1 + epoch / 2)
        for i in rng.permutation(len(rows)):
            ids, values = rows[i]
            y = labels[i]
            if y * (w[ids] @ values + b) < 1:
                w[ids] += rate * y * values
                b += rate * y * 0.1
        w *= max(0.0, 1 - penalty * rate * len(rows))
        if epoch >= epochs // 2:
            total += w
            total_b += b
    n = epochs - epochs // 2
    return total / n, total_b / n


def fitted(files: DataFrame, key: str = "file_id", sample: int = SAMPLE) -> tuple[Model, list[dict]]:
    """The model and its measures on held-out projects (a fifth, by hash), with heads seen and masked."""
    # Keys are chosen without their contents.
    chosen = _code(files).where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(sample)
    few = F.col("content").isNotNull() & (F.length("content") <= SAMPLE_BYTES)
    rows = _code(files).join(F.broadcast(chosen), key).where(few).groupBy(key).agg(F.min(F.struct("project", "path", "content")).alias("_r")).orderBy(F.xxhash64(key), key).select("_r.*").toArrow()
    xs, ys, held, bodies, owners = [], [], [], [], {}
    total = 0
    for project, path, content in zip(*[rows.column(c).to_pylist() for c in ("project", "path", "content")]):
        total += len(content)
        if total > SAMPLE_TOTAL:
            break
        xs.append(sparse(content, path))
        ys.append(bool(label(content)))
        body = split(content)[1]
        bodies.append(fingerprint(body) if len(body) >= LABEL_BYTES else None)
        owners.setdefault(bodies[-1], []).append((project, ys[-1]))
        held.append(zlib.crc32((project or "").encode()) % 5 == 0)
    # A copy of a labelled file is of its sort, and so is a body that several projects have.
    copied = {p for p, x in owners.items() if p and (2 * sum(z for _, z in x) >= len(x) or len({q for q, _ in x}) > 1)}
    ys = np.array([1.0 if y or p in copied else -1.0 for y, p in zip(ys, bodies)])
    held = np.array(held, bool)
    if not (ys[~held] > 0).any() or not (ys[~held] < 0).any():
        return Model(np.zeros((4, 1 << BITS), np.float32), -1.0), [{"head": h, "rows": float(len(ys))} for h in ("seen", "masked")]

    def seen(x: tuple[np.ndarray, np.ndarray, int]) -> Row:
        return x[0], x[1]

    def masked(x: tuple[np.ndarray, np.ndarray, int]) -> Row:
        return x[0][: x[2]], x[1][: x[2]]

    train = [x for x, h in zip(xs, held) if not h]
    w, b = fit([seen(x) for x in train] + [masked(x) for x in train], np.concatenate([ys[~held]] * 2))
    true = ys[held] > 0
    margins = {name: np.array([w[i] @ v + b for i, v in (take(x) for x, h in zip(xs, held) if h)]) for name, take in (("seen", seen), ("masked", masked))}
    order = np.argsort(-margins["seen"])
    precise = np.flatnonzero(np.cumsum(true[order]) >= PRECISE * np.arange(1, len(order) + 1))
    threshold = max(LEAST, float(margins["seen"][order[precise[-1]]]) - 1e-9) if len(precise) else LEAST
    measures = [
        {
            "head": name, "rows": float(len(ys)), "held_out": float(held.sum()), "positive": float(true.sum()), "found": float(found.sum()),
            "precision": float((found & true).sum() / max(1, found.sum())), "recall": float((found & true).sum() / max(1, true.sum())),
        }
        for name, found in ((n, m > threshold) for n, m in margins.items())
    ]
    return Model(w.reshape(4, 1 << BITS).astype(np.float32), float(b), threshold), measures


def fingerprint(body: bytes) -> bytes | None:
    """Of a body whatever its line ends and the blanks before them; none for a blank one."""
    text = b"\n".join(x.rstrip() for x in body.splitlines()).strip()
    return blake2b(text, digest_size=12).digest() if text else None


def _code(files: DataFrame) -> DataFrame:
    extensions = [e for e, x in syntax.LANGUAGE.items() if x in LANGUAGES]
    return files.where(F.lower("extension").isin(extensions))


def judged(files: DataFrame, model: Model, key: str = "file_id", at: str = "scanned_at") -> DataFrame:
    """(key, score, body): margin over the threshold; fingerprint of the body, null if blank."""
    src = _code(files).where(F.col(key).isNotNull() & F.col("content").isNotNull()).select(key, at, "path", "content")
    shared = files.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def make():  # noqa: ANN202
        own = shared.value

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            contents = b.column(3).to_pylist()
            score, bodies = own.scores(contents, b.column(2).to_pylist())
            score[[i for i, c in enumerate(contents) if not c.strip()]] = -9.0
            return pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(score), pa.array([fingerprint(x) for x in bodies], pa.binary())], names=[key, at, "score", "body"])

        return batch

    t = {f.name: f.dataType.simpleString() for f in src.schema}
    rows = map_batches(src, make, f"{key} {t[key]}, {at} {t[at]}, score double, body binary")
    return rows.groupBy(key).agg(F.max_by(F.struct("score", "body"), F.struct(at, "score", "body")).alias("_r")).select(key, "_r.*")


def found(files: DataFrame, key: str = "file_id", at: str = "scanned_at", sample: int = SAMPLE) -> DataFrame:
    """(key, way): the generated, minified, third-party and data files, by "margin" or as "copy" of such files."""
    model, _ = fitted(files, key, sample)
    j = judged(files, model, key, at)
    own = j.where("score > 0").select(key, F.lit("margin").alias("way"))
    # Only the files that aren't over the threshold themselves have to meet their body's others.
    mixed = j.where("body is not null").groupBy("body").agg(F.count_if(F.col("score") > 0).alias("over"), F.count("*").alias("n")).where("over > 0 and over < n and 2 * over >= n").select("body")
    return own.unionByName(j.where("score <= 0 and body is not null").join(mixed, "body", "left_semi").select(key, F.lit("copy").alias("way")))


def not_handwritten(files: DataFrame, key: str = "file_id", at: str = "scanned_at", sample: int = SAMPLE) -> DataFrame:
    """(key) of the generated, minified, third-party and data files."""
    return found(files, key, at, sample).select(key)


def ways(files: DataFrame, key: str = "file_id", at: str = "scanned_at") -> DataFrame:
    """(way, files): how many rows the margin decides, and how many come as copies."""
    return found(files, key, at).groupBy("way").agg(F.count("*").alias("files"))


def measures(files: DataFrame, key: str = "file_id", sample: int = SAMPLE) -> DataFrame:
    """The classifier's measures against the labels of held-out projects, a row with heads seen and one with heads masked."""
    _, m = fitted(files, key, sample)
    names = ["rows", "held_out", "positive", "found", "precision", "recall"]
    return files.sparkSession.createDataFrame([(x["head"], *[x.get(n) for n in names]) for x in m], "head string, " + ", ".join(f"{n} double" for n in names))
