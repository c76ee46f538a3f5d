"""Secret spans: fixed patterns against plain ones, and precision and recall of the models."""

import random
import re
import string
import time

import pytest

from intelspark.llm import secrets

PLAIN = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]


def plain(text):
    found = [(m.start(), 0, m.end()) for m in PLAIN[0].finditer(text) if len(m[2]) >= 6]
    return sorted(found + [(m.start(), k, m.end()) for k, least in ((1, 20), (2, 24)) for m in PLAIN[k].finditer(text) if m.end() - m.start() >= least])


@pytest.fixture(scope="module")
def ratios(spark):
    return secrets.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))


def test_base_spans_equal_the_plain_patterns(ratios):
    rng = random.Random(9)
    parts = ["password", "Token", "api_key", " = ", ": '", "AKIA", "ABCDEFGHIJ0123456789", "0a1b2c3d", "deadbeefcafe", "é", "😀", " ", "\n", "-", "x", "K", "ſecret=abcdefg"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        every = secrets.spans(text, ratios)
        assert [s for s in every if s[1] < 3] == plain(text), text
        assert all(not (a < y and x < b) for a, k, b in every if k == 3 for x, _, y in plain(text))


ORDINARY = (
    "getUserAccountByIdentifier java/util/concurrent/ConcurrentHashMap XMLHttpRequestEventTarget docs/api/v1/users/index test_case_number_12345_v2 QWERTYUIOPASDFGHJKL "
    "======================== -------------------------------- ________________________ org/apache/spark/sql/catalyst SPARK_SQL_SHUFFLE_PARTITIONS 2024-01-01-2024-12-31 "
    "internationalization-and-localization AbstractSingletonProxyFactoryBean very_long_variable_name_for_counter /usr/local/share/applications node_modules/react-dom/index "
    "donaudampfschifffahrtsgesellschaft anticonstitutionnellement abcdefghijklmnopqrstuvwxyz 12345678901234567890").split()


def test_ordinary_strings_are_left_alone(ratios):
    assert [t for t in ORDINARY if secrets.spans(f"see {t} here", ratios)] == []
    made = secrets.made_ordinary(2000, seed=77)
    assert sum(bool(secrets.spans(f"see {t} here", ratios)) for t in made) <= 0.02 * len(made)


@pytest.mark.parametrize("letters", [string.ascii_letters + string.digits, secrets.ALPHABET[:64], string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits])
def test_random_strings_are_found(ratios, letters):
    rng = random.Random(10)
    for n in (16, 20, 24, 32, 40):
        hits = sum(bool(secrets.spans(f"see {''.join(rng.choices(letters, k=n))} here", ratios)) for _ in range(200))
        assert hits >= 190, n


def test_time_is_linear(ratios):
    for unit in ("some words 0a1b2c3d0a1b2c3d0a1b2c3d0a1b2c3d é ", "token=abcdefghijklmnopqrstuvwxyz0 ", "a" * 50, "AKIA"):
        text = (unit * (528_000 // len(unit) + 1))[:528_000]
        start = time.time()
        secrets.spans(text, ratios)
        assert time.time() - start < 3, unit
