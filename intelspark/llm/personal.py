"""Personal data: patterns, gazetteers and context vote on candidate spans, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intelspark.llm.common import map_partition
from intelspark.session import cut_lineage

# Fixed patterns of the base kinds. Runs are possessive where no shorter match could succeed, so scans are linear. A pattern
# begins with its first character, not with a look back, as re then goes from one such character to the next.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

KINDS = ("email", "ip", "card", "phone", "hidden_email", "number", "account", "name", "birth_date")
BASE = 4  # kinds before this are the fixed patterns'
NEAR = 48  # characters before a candidate that context labelers read
AFTER = 16
PER_KIND = 600  # candidates of each kind that the classifier learns from
FEATURES = 1 << 12
ACCEPT = 0.7  # least probability of an added span
ROUNDS = 60  # of expectation-maximisation

# Gazetteers and context words of the labelers.
FIRST_NAMES = (
    "Alice Anna Antonio Carlos Carmen Charles Christine David Elena Elizabeth Emma Francisco Hans Heinrich James Jean Jennifer Johann John Jose "
    "Juan Karl Laura Linda Louis Luis Maria Marie Mary Michael Michel Miguel Nicolas Patricia Paul Pedro Peter Pierre Richard Robert Sarah Sofia "
    "Sophie Stefan Susan Thomas Ursula William Wolfgang").split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Monsieur Madame Mademoiselle Senor Senora Don Dona".split()
DOMAIN_ENDS = frozenset("ar at au be biz br ca ch cl cn co com cz de dk edu es eu fi fr gov gr hk ie in info int io it jp kr mx net nl no nz org pl pt ru se sg tw uk us".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 852 853 886 966 971 972".split())
CARD_STARTS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
ACCOUNT_LANDS = frozenset("AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK TR".split())
CONTEXT = {
    "email": "mail e-mail contact reach write address correo courriel kontakt",
    "ip": "ip host server address login client from adresse servidor",
    "card": "card visa mastercard amex credit debit pay karte carte tarjeta",
    "phone": "phone tel call mobile cell fax whatsapp dial telefon telefono ring contact",
    "hidden_email": "mail e-mail contact reach write address correo courriel kontakt",
    "number": "phone tel call mobile cell fax whatsapp dial telefon ssn security passport insurance steuer nif dni",
    "account": "iban account bank bic swift transfer konto compte cuenta",
    "name": "name named mr mrs dr author by dear signed patient contact sincerely",
    "birth_date": "born birth dob birthday geboren nacido naissance",
}
CONTEXT = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}
OPPOSED = frozenset("version v isbn issn doi order invoice sku part page pages no figure table section ticket build serial issue vol chapter ratio hash sha md5 usd eur total price".split())

HIDDEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]+(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+")  # and a bracket before it
ACCOUNT = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LED = {a: "|".join(n[1:] for n in TITLES + FIRST_NAMES if n[0] == a) for a in sorted({n[0] for n in TITLES + FIRST_NAMES})}
NAME = re.compile(
    rf"[{''.join(_LED)}](?<!\w[A-Z])(?:{'|'.join(f'(?<={a})(?:{rest})' for a, rest in _LED.items())})"
    r"\.?\x20[A-ZÀ-Þ][a-zß-ÿ]{1,30}(?:\x20[A-ZÀ-Þ][a-zß-ÿ]{1,30})?(?!\w)")
BIRTH = re.compile(
    r"[0-9](?<![0-9./-][0-9])(?:[0-9]?[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:(?<=1)9|(?<=2)0)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])")
GROUPED = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}")
WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)?")
LABELERS = ("pattern", "checksum", "shape", "gazetteer", "context", "opposed", "company", "dull", "embedded")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _mod_97(account: str) -> bool:
    code = "".join(account.split())
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def has_digit(text: str) -> bool:
    return any(d in text for d in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the fixed patterns in code points, by start, then kind."""
    out, done = [], 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        at = m.start()
        while at > done and text[at - 1] in LOCAL:
            at -= 1
        if at < m.start():
            out.append((at, 0, m.end()))
            done = m.end()
    digits = has_digit(text)
    for m in ADDRESS.finditer(text) if digits and "." in text else ():
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text) if digits else ():
        if m.end() - m.start() >= 14 and 14 <= len(card := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(card):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans and other spans that may be personal, none of which overlaps an earlier one kept."""
    more = []
    if "at)" in text or "at]" in text:
        more += [(m.start(), 4, m.end()) for m in HIDDEN.finditer(text)]
    if has_digit(text):
        more += [(m.start(), 6, m.end()) for m in ACCOUNT.finditer(text)]
        more += [(m.start(), 8, m.end()) for m in BIRTH.finditer(text)]
        for m in NUMBER.finditer(text):
            start = m.start() - (text[m.start() - 1 : m.start()] == "(")
            glued = (start and (text[start - 1].isalnum() or text[start - 1] in "_+.-")) or text[m.end() : m.end() + 1].isalnum()
            if not glued and sum(c.isdigit() for c in m[0]) <= 19:
                more.append((start, 5, m.end()))
    more += [(m.start(), 7, m.end()) for m in NAME.finditer(text)]
    out, last = [], -1
    fixed = iter([*sorted(base), (len(text) + 1, 0, len(text) + 1)])
    nxt = next(fixed)
    for s in sorted(more, key=lambda s: (s[0], KINDS[s[1]] == "number", s)):  # a number is what nothing else explains
        while nxt[0] < s[0]:
            last = max(last, nxt[2])
            nxt = next(fixed)
        if s[0] >= last and s[2] <= nxt[0]:
            out.append(s)
            last = s[2]
    return sorted(base + out)


def _votes(text: str, spans: list[tuple[int, int, int]], k: int) -> tuple[list[int], list[int]]:
    """Votes of the labelers on one candidate (0 abstains, 1 against, 2 for), and its hashed features."""
    start, kind, end = spans[k]
    name, span = KINDS[kind], text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    before = WORD.findall(text[max(0, start - NEAR) : start].lower())
    after = WORD.findall(text[end : end + AFTER].lower())
    left, right = text[start - 1 : start] or " ", text[end : end + 1] or " "
    long_digits = name in ("card", "number") and len(digits) >= 14
    summed = luhn(digits) if long_digits else _mod_97(span) if name == "account" else None
    listed = {
        "email": lambda: span.rsplit(".", 1)[-1].lower() in DOMAIN_ENDS, "hidden_email": lambda: WORD.findall(span)[-1].lower() in DOMAIN_ENDS,
        "phone": lambda: any(digits[:n] in COUNTRY_CODES for n in (1, 2, 3)), "card": lambda: digits.startswith(CARD_STARTS),
        "account": lambda: span[:2] in ACCOUNT_LANDS, "name": lambda: span.split()[0].strip(".") in FIRST_NAMES,
    }.get(name)
    grouped = GROUPED.fullmatch(span) is not None if name in ("number", "phone") else None
    near = any(0 <= j < len(spans) and spans[j][1] != kind and (start - spans[j][2] if j < k else spans[j][0] - end) < 80 for j in (k - 1, k + 1))
    dull = name in ("ip", "card", "phone", "number") and (len(set(digits)) <= 2 or digits in "01234567890123456789" or span.startswith(("0.", "127.")))
    votes = [
        2 if kind < BASE else 0,
        0 if summed is None else 2 if summed else 1,
        2 if grouped else 1 if name == "number" else 0,
        0 if listed is None else 2 if listed() else 1,
        2 if CONTEXT[name].intersection(before[-5:]) else 1 if kind >= BASE else 0,
        1 if OPPOSED.intersection(before[-2:] + after[:1]) else 0,
        2 if near else 0,
        1 if dull else 0,
        1 if left in "_/\\=#&?" or right in "_/\\=%" else 0,
    ]
    shape = re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", span)))[:32]
    facts = [name, f"{name} {shape}", f"{name} {min(len(span), 40) // 4}", f"{name} {summed} {grouped}", f"{name} {votes[3]}", f"l {left if not left.isalnum() else 'a'}",
             f"r {right if not right.isalnum() else 'a'}", f"{name} near {near}", *[f"{name} b {w}" for w in before[-4:]], *[f"{name} a {w}" for w in after[:2]]]
    return votes, sorted({crc32(f.encode("utf-8", "surrogatepass")) % FEATURES for f in facts})


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def candidate_rows(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base counts and hash, and its candidates with the labelers' votes (base 3) and features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "starts", "kinds", "ends", "votes", "features")}
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = candidates(text, base)
                judged = [_votes(text, spans, k) for k in range(len(spans))]
                row = (*(sum(s[1] == k for s in base) for k in range(BASE)), sha256(written(base).encode()).hexdigest(), *([s[i] for s in spans] for i in range(3)),
                       [int("".join(map(str, v)), 3) for v, _ in judged], [f for _, f in judged])
                for name, value in zip(out, row):
                    out[name].append(value)
            yield {"doc_id": batch.column("doc_id"), **out}

    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, starts array<int>, kinds array<int>, ends array<int>, "
              "votes array<int>, features array<array<int>>")
    return map_partition(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, schema)


@dataclass
class Model:
    """What is learned: how often each labeler is right when it votes, and the classifier's weights."""

    reliability: np.ndarray
    weights: np.ndarray


def aggregate(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(probability that candidates of each row are personal, reliabilities) from vote patterns and how often each occurs.

    Expectation-maximisation of a model in which labelers that do not abstain are right at a rate of their own,
    independently given the truth, and each kind has its share of personal candidates. Prior counts, a
    twentieth of the data, say that labelers are better than chance.
    """
    strength = 0.05 * counts.sum() + 5
    for_it, against = (votes == 2).astype(float), (votes == 1).astype(float)
    truth = np.clip(0.5 + 0.2 * (for_it - against).sum(1), 0.05, 0.95)
    rates, right = np.full(len(KINDS), 0.5), np.full(votes.shape[1], 0.8)
    for _ in range(rounds if len(counts) else 0):
        yes, no = counts * truth, counts * (1 - truth)
        right = (yes @ for_it + no @ against + 0.8 * strength) / (counts @ (for_it + against) + strength)
        rates = (np.bincount(kinds, yes, len(KINDS)) + 1) / (np.bincount(kinds, counts, len(KINDS)) + 2)
        weight = np.log(right) - np.log(1 - right)
        log = (for_it - against) @ weight + np.log(rates[kinds]) - np.log(1 - rates[kinds])
        truth = 1 / (1 + np.exp(-np.clip(log, -500, 500)))
    return truth, right


def train(features: list[list[int]], truth: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on hashed features (the last weight is the bias), fitted to probabilities."""
    weights = np.zeros(FEATURES + 1)
    if not len(truth):
        return weights
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.concatenate([np.asarray(f, np.int64) for f in features])
    square = np.full(FEATURES + 1, 1e-6)
    for _ in range(rounds):
        logit = np.bincount(row, weights[col], len(truth)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - truth
        slope = np.append(np.bincount(col, error[row], FEATURES), error.sum()) / len(truth) + 1e-4 * weights
        square += slope**2
        weights -= 0.3 * slope / np.sqrt(square)
    return weights


def fit(rows: DataFrame, per_kind: int = PER_KIND) -> Model:
    """Learns from ``candidate_rows``: reliabilities from the vote patterns of all candidates, the classifier from ``per_kind`` of each kind.

    Vote patterns are at most 3^labelers per kind, whatever the corpus. Sampled are the candidates of the smallest hashes.
    """
    each = rows.select(F.explode(F.arrays_zip("kinds", "votes", "features", "starts")).alias("c"), "doc_id").select("c.kinds", "c.votes", "c.features", "c.starts", "doc_id")
    patterns = each.groupBy("kinds", "votes").count().collect()
    kinds, codes, counts = (np.array([r[i] for r in patterns], np.int64).reshape(-1) for i in range(3))
    votes = codes.reshape(-1, 1) // 3 ** np.arange(len(LABELERS) - 1, -1, -1) % 3
    truth, reliability = aggregate(kinds, votes, counts.astype(float))
    known = dict(zip(zip(kinds.tolist(), codes.tolist()), truth.tolist()))
    order = W.partitionBy("kinds").orderBy(F.xxhash64("doc_id", "starts"), "doc_id", "starts")
    sample = each.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= per_kind).select("kinds", "votes", "features").collect()
    return Model(reliability, train([r.features for r in sample], np.array([known[r.kinds, r.votes] for r in sample])))


def judge(rows: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``candidate_rows`` with found: array of (kind, start, end, score), the base spans and those the classifier adds."""
    weights = model.weights.astype(np.float32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = []
            for starts, kinds, ends, features in zip(*(batch.column(c).to_pylist() for c in ("starts", "kinds", "ends", "features"))):
                kept = []
                for a, k, b, f in zip(starts, kinds, ends, features):
                    score = float(1 / (1 + np.exp(-(weights[f].sum() + weights[-1]))))
                    if k < BASE or score >= accept:
                        kept.append({"kind": KINDS[k], "start": a, "end": b, "score": score})
                found.append(kept)
            yield {**{c: batch.column(c) for c in names[:-1]}, "found": found}

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"]
    schema = ", ".join(f"{c} long" for c in names[:5]) + ", base_sha256 string, found array<struct<kind: string, start: int, end: int, score: double>>"
    return map_partition(rows, work, schema)


def scan(docs: DataFrame) -> DataFrame:
    """Personal data of every row of ``docs`` (doc_id, text): counts and hash of the base spans, and all spans found.

    Base spans are those of the fixed patterns (email, ip, card, phone). Other spans (emails written out, numbers
    in groups, bank accounts, names, dates of birth) are candidates, judged by the classifier and never overlapping
    an earlier span. A null or empty text has no spans; rows are judged on their own, also repeated ones
    and those without doc_id; other columns are ignored, and without candidates there is nothing to learn.
    """
    rows = cut_lineage(candidate_rows(docs))
    return judge(rows, fit(rows))
