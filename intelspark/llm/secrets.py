"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from intelspark.llm.common import map_partition, release

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}  # characters of the value, the key, the run
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SHORTEST = 16  # characters of a run that the models judge
SAMPLE = 2000  # documents that the models learn from
MADE = 3000  # random strings made for the model of random strings, beside those the patterns label
ORDINARY = 9000  # identifiers, paths and rows of marks made for the model of ordinary strings
TOTAL, MEAN = 12.0, 0.6  # least log-likelihood ratio of a run, and per character
# Words that identifiers and paths are made of, and orders of keys that people type.
WORDS = (
    "access account action active add address admin agent alert all api app apply array as async auth author auto back base batch bean bin block body book bool box branch buffer build button by "
    "cache call case cell change chart check child class clear click client close cloud code collection color column command common component concurrent config connect constant content context control core count create "
    "current custom data database date default delete description detail device dialog dictionary directory disable display docs document domain down download edit element email enable end engine entry error event example "
    "execute export factory feature field file filter find first float folder font form format frame from function get global graph group guide handler hash header height help hidden history home http icon id identifier "
    "image import index info init input insert int interface internal item java job json key label language last layout length level library like line link list listener load local location log login main manager map "
    "master match menu message method mode model module month name network new next node number object option order output package page panel parent password path people phone play point pool position post process "
    "product profile project property provider public query queue read record redirect ref region release remote report request reset resource response result return role root row rule run save scale scan schema "
    "screen script search section security select send server service session set shared show size sort source start state status step store stream string style submit support sync system table target task test text "
    "thread time title token tool top total track tree type unit update upload url user util valid value version view watch web widget width window word work write xml year zone"
).split()
SHORT = "API AWS CPU CSS CSV DB DNS GPU HTML HTTP HTTPS ID IO IP JSON JVM OS PDF REST SDK SQL SSH SSL TCP TLS UI URI URL UTF UUID VM XML YAML".split()
TYPED = ("abcdefghijklmnopqrstuvwxyz", "qwertyuiop", "asdfghjkl", "zxcvbnm", "01234567890123456789", "qwertyuiopasdfghjklzxcvbnm")
_SIZE = len(ALPHABET)
_CODE = np.full(256, -1, np.int16)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(_SIZE)


def runs(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the runs over the alphabet with ``SHORTEST`` characters or more; hex runs and keys lie inside these."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _CODE[np.frombuffer(raw, np.uint8)] >= 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= SHORTEST
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def places(raw: bytes) -> np.ndarray | None:
    """Code points before each byte of a text and before its end; None where both count alike."""
    data = np.frombuffer(raw, np.uint8)
    if not (data >= 128).any():
        return None
    return np.append(0, np.cumsum((data & 0xC0) != 0x80))


def base_spans(text: str, raw: bytes, found: list[tuple[int, int]], at: np.ndarray | None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the fixed patterns in code points, in order; ``at`` are the ``places`` of ``raw``."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for a, b in found:
        run = raw[a:b].decode()
        first = a if at is None else int(at[a])
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            for m in pattern.finditer(run):
                if m.end() - m.start() >= LEAST[KINDS[kind]]:
                    out.append((first + m.start(), kind, first + m.end()))
    return sorted(out)


def made_ordinary(n: int = ORDINARY, seed: int = 12) -> list[str]:
    """Identifiers in the usual spellings, paths, numbered names, orders of keys and rows of one character."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        words = [WORDS[i] for i in rng.integers(0, len(WORDS), rng.integers(2, 6))]
        if k % 5 == 0:
            words[int(rng.integers(len(words)))] = SHORT[int(rng.integers(len(SHORT)))]
        number = str(int(rng.integers(1, 10 ** int(rng.integers(1, 6)))))
        form = k % 9
        if form < 2:
            text = words[0] + "".join(w[0].upper() + w[1:] for w in words[1:])
        elif form == 2:
            text = "".join(w[0].upper() + w[1:] for w in words)
        elif form == 3:
            text = "_".join(words)
        elif form == 4:
            text = "-".join(words)
        elif form == 5:
            text = "/".join(words) + ("/v" + number[:1] if k % 2 else "")
        elif form == 6:
            text = "_".join(words).upper()
        elif form == 7:
            text = "_".join([*words, number])
        else:
            text = "/".join(words[:-1]) + "/" + words[-1][0].upper() + words[-1][1:] + words[0][0].upper() + words[0][1:]
        out.append(text)
    typed = [v for t in TYPED for v in (t, t.upper(), t[::-1])] * (n // 300)
    return out + typed + [c * 24 for c in ALPHABET] * (n // 900)


def _pairs(run: bytes) -> np.ndarray:
    code = _CODE[np.frombuffer(run, np.uint8)].astype(np.int64)
    return code[:-1] * _SIZE + code[1:]


def _counts(texts: list[str]) -> np.ndarray:
    """Character pairs in labelled samples: row 0 of values that the patterns find, row 1 of all other runs of letters."""
    out = np.zeros((2, _SIZE * _SIZE), np.int64)
    for text in texts:
        secret = [False] * (len(text) + 1)
        raw = text.encode("utf-8", "surrogatepass")
        for a, _, b in base_spans(text, raw, runs(raw), places(raw)):
            secret[a:b] = [True] * (b - a)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{4,}", text):
            pairs = _pairs(m[0].encode())
            np.add.at(out[0 if secret[m.end() - 1] else 1], pairs, 1)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Log-likelihood ratios of character pairs, random strings over ordinary words and identifiers.

    Samples are labelled by the fixed patterns in ``sample`` documents, those of the smallest id hashes;
    ``MADE`` strings of random characters (letters and digits, base64, hex) join the random ones, and the
    ``ORDINARY`` identifiers, paths and rows of marks of ``made_ordinary`` the ordinary ones, which prose alone lacks.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    chosen = spark.createDataFrame(ids, docs.select("doc_id").schema).distinct()
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")  # at most ``sample`` ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((2, _SIZE * _SIZE), np.int64)
        for batch in batches:
            total += _counts([t or "" for t in batch.column(0).to_pylist()])
        at = np.nonzero(total)
        yield {"side": at[0], "pair": at[1], "n": total[at]}

    counts = np.zeros((2, _SIZE * _SIZE))
    for side, pair, n in map_partition(rows, work, "side int, pair int, n long").groupBy("side", "pair").agg(F.sum("n")).collect():
        counts[side, pair] = n
    rng = np.random.default_rng(11)
    for letters in (ALPHABET[:62], ALPHABET[:64], "0123456789abcdef"):
        made = np.frombuffer(letters.encode(), np.uint8)[rng.integers(0, len(letters), (MADE // 3, 32))]
        for row in made:
            np.add.at(counts[0], _pairs(row.tobytes()), 1)
    for text in made_ordinary():
        np.add.at(counts[1], _pairs(text.encode()), 1)
    pairs = counts.reshape(2, _SIZE, _SIZE)
    single = pairs.sum(1, keepdims=True) + 0.5  # pairs not seen fall back on how common the second character is
    log = np.log((pairs + 5 * single / single.sum(2, keepdims=True)) / (pairs.sum(2, keepdims=True) + 5))
    return (log[0] - log[1]).ravel()


def spans(text: str, ratios: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans of a text: those of the patterns, and other runs that look random; (start, index of the kind, end).

    Linear in the text but for sorting the spans: runs and the patterns' spans are met in one sweep.
    """
    raw = text.encode("utf-8", "surrogatepass")
    found = runs(raw)
    at = places(raw) if found else None
    fixed = base_spans(text, raw, found, at)
    out, k, reach = list(fixed), 0, -1
    for a, b in found:
        first = a if at is None else int(at[a])
        last = first + b - a
        while k < len(fixed) and fixed[k][0] < last:
            reach = max(reach, fixed[k][2])  # the farthest end of the spans that begin before the run ends
            k += 1
        if reach <= first:
            ratio = ratios[_pairs(raw[a:b])]
            if ratio.sum() >= TOTAL and ratio.mean() >= MEAN:
                out.append((first, 3, last))
    return sorted(out)


def written(rows: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def scan(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """All columns of ``docs`` (with text) and n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end in code points by start, then kind; a null or empty text has none.
    Every row is judged on its own. Columns of these names in ``docs`` are replaced.
    """
    added = StructType.fromDDL("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    left = docs.drop(*added.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                every = spans(text or "", ratios)
                base = [s for s in every if s[1] < 3]
                rows.append((*(sum(s[1] == k for s in base) for k in range(3)), sha256(written(base).encode()).hexdigest(), written(every)))
            if rows:
                new = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(),) * 3 + (pa.string(),) * 2)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added.fieldNames()])

    return left.mapInArrow(run, StructType([*left.schema.fields, *added.fields]))


def redact(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[secret]`` and n_chars, where there is one, counted anew.

    Overlapping spans are replaced together; texts without a span, null ones too, stay as they are.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            changed = {}
            for i, text in enumerate(texts):
                if text and (found := spans(text, ratios)):
                    out, done = [], 0
                    for a, _, b in found:
                        if b > done:
                            if a >= done:
                                out += [text[done:a], "[secret]"]
                            done = b
                    changed[i] = "".join([*out, text[done:]])
            columns = list(batch.columns)
            if changed:
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
                n = batch.schema.get_field_index("n_chars")
                if n >= 0:
                    columns[n] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(columns[n].to_pylist())], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
