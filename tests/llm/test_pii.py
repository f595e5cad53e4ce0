import hashlib
import math
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pii

from .conftest import prose

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        s = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@1234 5+-()0é9\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "a" * 300_000 + "@", "(at)" * 50_000):
        pii.candidates(text)
    assert time.time() - began < 20


def documents():
    rng = random.Random(2)
    rows = []
    for k in range(200):
        kind = k % 8
        thing = [
            f"u{k}@mail.example.com", f"10.{k}.3.4", "4111 1111 1111 1111", f"+1 (555) 010-{1000 + k}", f'token = "{rng.getrandbits(120):030x}"', f"password=a1{rng.getrandbits(64):016x}", f"call 555-123-{1000 + k}", "nothing",
        ][kind]
        rows.append((k, prose(k, 20) + " " + thing + " " + prose(k + 500, 20)))
    return rows


def test_find_keeps_base_spans_and_adds_secrets(spark):
    rows = documents()
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        base = sorted(plain(text), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        joined = ",".join(f"{c}:{a}:{b}" for a, b, c in base)
        assert got[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[k][f"n_{c}"] for c in pii.BASE] == [sum(s[2] == c for s in base) for c in pii.BASE]
        spans = [s.split(":") for s in got[k]["spans"].split(",") if s]
        assert set(map(tuple, (s.split(":") for s in joined.split(",") if s))) <= set(map(tuple, spans))
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)
        if k % 8 in (4, 5):
            assert any(s[0] == "secret" for s in spans), text
        if k % 8 == 7:
            assert not spans


def test_redact(spark):
    rows = documents()
    docs = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert "<EMAIL>" in got[0] and "<IP>" in got[1] and "<CARD>" in got[2] and "<PHONE>" in got[3] and "<SECRET>" in got[4]
    assert got[7] == dict(rows)[7] and not any("@mail" in t for t in got.values())


def test_odd_documents(odd_docs, no_docs):
    got = pii.find(odd_docs).collect()
    assert len(got) == odd_docs.count()
    r = next(r for r in got if r["doc_id"] == 13)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert pii.find(no_docs).count() == 0
    clean = pii.redact(odd_docs)
    assert clean.columns == odd_docs.columns and clean.where("text IS NULL").count() == odd_docs.where("text IS NULL").count()


def test_reliable_labelers_win():
    counts = {"secret|21211|5111|dl": 90, "secret|20200|5111|dl": 60, "secret|21210|5111|dl": 5, "secret|20211|5111|dl": 4}
    p = pii.train(counts)
    assert p["secret|21211|5111|dl"] > 0.5 > p["secret|20200|5111|dl"]
    assert pii.train({}) == {}


def test_em_over_patterns_equals_em_over_single_spans():
    """Dawid-Skene spelt out span by span, in plain Python."""
    rng = random.Random(3)
    counts = {f"{k}|{''.join(rng.choice('012') for _ in range(5))}|{n}111|d": rng.randrange(1, 6) for k in ("secret", "phone", "id") for n in range(8)}
    spans = [(k, [int(v) for v in k.split("|")[1]]) for k, n in counts.items() for _ in range(n)]
    p = []
    for _, v in spans:
        voted = [x for x in v if x < 2]
        p.append(min(0.95, max(0.05, sum(voted) / len(voted) if voted else 0.5)))
    for _ in range(50):
        rate = {}
        for y in (0, 1):
            weight = [q if y else 1 - q for q in p]
            for j in range(5):
                for x in range(3):
                    start = {0: {0: 8, 1: 2, 2: 5}, 1: {0: 2, 1: 8, 2: 5}}[y][x]
                    rate[y, j, x] = (sum(w for w, (_, v) in zip(weight, spans, strict=True) if v[j] == x) + start) / (sum(weight) + 15)
        prior = {}
        for kind in pii.KINDS:
            mine = [q for q, (k, _) in zip(p, spans, strict=True) if k.startswith(kind + "|")]
            prior[kind] = (1 + sum(mine)) / (2 + len(mine))
        new = []
        for k, v in spans:
            yes, no = prior[k.split("|")[0]], 1 - prior[k.split("|")[0]]
            for j, x in enumerate(v):
                yes, no = yes * rate[1, j, x], no * rate[0, j, x]
            new.append(yes / (yes + no))
        p = new
    got = pii.reliabilities(counts)
    assert all(abs(got[k] - q) < 1e-6 for q, (k, _) in zip(p, spans, strict=True))


def test_classifier_has_a_gradient_of_zero_at_its_fit():
    counts = {"secret|21211|5111|dl": 90, "secret|20200|3210|dl": 60, "phone|21210|2130|d": 5, "secret|20211|5112|dul": 4}
    p, soft = pii.train(counts, rounds=60), pii.reliabilities(counts)
    mean = sum(counts.values()) / len(counts)
    x = {k: pii._features(k) for k in counts}
    pull = sum(n / mean * (p[k] - soft[k]) * x[k] for k, n in counts.items())
    logit = {k: math.log(p[k] / (1 - p[k])) for k in counts}
    # with a ridge of 1 the weights are minus the pull, so they give the logits back
    assert all(abs(logit[k] - x[k] @ -pull) < 1e-4 for k in counts)


def test_addresses_of_any_length():
    name, host = "n" * 300, "h" * 200
    for text in (f"{name} (at) {host} (dot) {host} (dot) com", f"{name}[at]{'.'.join(['a'] * 50)}.org"):
        assert [text[a:b] for a, b, k in pii.candidates(text)[1] if k == "email"] == [text]


def test_many_spans_take_little_more_than_linear_time():
    began = time.time()
    base, extra = pii.candidates("10.1.2.3 key=ab12cd34ef56gh " * 30_000)
    assert len(base) == len(extra) == 30_000 and time.time() - began < 10


def test_plain_numbers_are_no_secrets():
    assert pii.candidates("the sum 2123465659789240 was paid") == ([], [])
    assert [s[2] for s in pii.candidates("key=2123465659789240")[1]] == ["secret"]


def test_secrets_of_any_length_and_with_signs_before_the_first_digit_are_candidates():
    pattern = [p for kind, p, _ in pii._LOOSE if kind == "secret"][-1]
    for secret in ("ghp_16C7e42F292c6912E7", "sk_live_4eC39HqLyjWDarjtT1", "a1B2" * 40, "x" * 80 + "7"):
        for text in (f'token="{secret}"', f"api_key={secret}", f"the key {secret} is here"):
            assert [m.group() for m in pattern.finditer(text)] == [secret]
    began = time.time()
    for run in ("a" * 1_000_000, "_-" * 500_000, "1" * 1_000_000, "a1" * 500_000, ' "=' * 300_000):
        list(pattern.finditer(" " + run))
    assert time.time() - began < 5
