"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Candidates are the spans of the four base patterns (e-mail, IP address, card, phone) and those of looser patterns for
secrets, spelt-out addresses, local phone numbers and identity numbers. Regex, gazetteer and context labelers each vote
for, against or abstain. Candidates with the same kind, votes and shape are one *pattern*; the corpus gives a count for
each pattern, over all documents. Expectation-maximisation over these counts estimates how reliable each labeler is and
how likely each pattern is private; a logistic span classifier is trained on these soft labels, with features of the span that no labeler
votes on (length, variety, order of characters, what stands before). Base spans always stay;
other candidates are added if the classifier says so and they overlap nothing that is kept.

The number of patterns is bounded by the code below (kinds x 3^labelers x shapes), whatever the input; only they reach the driver.

Defined results: null text is empty; repeated rows give repeated results; a null id stays null; an empty table gives no
rows; other columns are ignored. Patterns are matched in time linear in the text, long runs of digits or letters included.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits cannot be entered in its middle with another outcome, so the look-behind and possessive repeats change
# no match; they keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[ ]?[(\[]at[)\]][ ]?[A-Za-z0-9-]++(?:(?:\.|[ ]?[(\[]dot[)\]][ ]?)[A-Za-z0-9-]++)++"), "at"),
    ("phone", re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"), None),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"), None),
    ("secret", re.compile(r"(?:(?<=[=:\"'])|(?<= )(?=[0-9]*+[A-Za-z]))(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{12,}+"), None),
    ("id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), None),
)

# fixed values: gazetteers. Ends of domains; country calling codes; how numbers of card issuers begin; how tokens of known services begin;
# first parts of addresses that name no host of others; area numbers that were never given out
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name pro io co ai app dev me tv cc xyz online site shop example "
    "ar at au be bg br ca ch cl cn co cz de dk ee es eu fi fr gr hk hr hu id ie il in ir is it jp ke kr lt lu lv ma mx my ng nl no nz "
    "pe ph pk pl pt ro rs ru sa se sg si sk th tr tw ua uk us uy ve vn za".split()
)
CALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "211 212 213 216 218 220 221 225 226 227 228 229 230 231 233 234 237 243 244 250 251 254 255 256 258 260 263 264 350 351 352 353 354 355 356 357 358 359 "
    "370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 501 502 503 504 505 506 507 509 591 592 593 595 597 598 673 852 853 855 856 880 886 "
    "960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998"
).split()
ISSUERS = ("4", "51", "52", "53", "54", "55", *map(str, range(222, 273)), "34", "37", "6011", "64", "65", "35", "30", "36", "38", "39", "50", "56", "57", "58", "62", "67")
TOKENS = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- sk_live_ sk_test_ pk_live_ rk_live_ sk- xoxb- xoxp- xoxa- AIza ya29. eyJ npm_ pypi- SG. hf_ dop_v1_ shpat_ whsec_".split()
NO_HOST = ("0", "10", "127", *map(str, range(224, 256)))
NO_AREA = ("000", "666", *map(str, range(900, 1000)))
CUES = {
    "email": frozenset("mail email e-mail contact write address correo courriel kontakt".split()),
    "ip": frozenset("ip host server address addr client from serveur servidor".split()),
    "card": frozenset("card visa mastercard credit payment karte carte tarjeta kreditkarte".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon telefono".split()),
    "secret": frozenset("password passwd pwd token secret key apikey api_key access_key passwort contrasena".split()),
    "id": frozenset("ssn social security id identity passport ausweis".split()),
}
AGAINST = frozenset("version isbn issn order invoice ref page chapter section figure table doi v sha md5 commit".split())
_WORDS = re.compile(r"[A-Za-z_-]+")
_CALLING, _TOKENS = tuple(CALLING), tuple(TOKENS)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by kind: leftmost, not overlapping, failing matches dropped."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, m.end(), "email"))
                last = m.end()
    if not any(d in text for d in "0123456789"):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((*m.span(), "phone"))
    return out


def candidates(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and looser ones that overlap no base span nor an earlier looser one."""
    base = base_spans(text)
    if not any(d in text for d in "0123456789") and "at" not in text and "AKIA" not in text and "ASIA" not in text:
        return base, []
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for a, b, _ in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    extra = []
    for kind, pattern, needs in _LOOSE:
        if needs and f"({needs})" not in text and f"[{needs}]" not in text:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            k = bisect_left(taken, (a, b))
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                extra.append((a, b, kind))
                taken.insert(k, (a, b))
    return base, extra


def votes(text: str, a: int, b: int, kind: str, is_base: bool) -> tuple[int, ...]:
    """Of each labeler: 1 private, 0 not, 2 abstains."""
    span = text[a:b]
    before = [w.lower() for w in _WORDS.findall(text[max(0, a - 40) : a])][-3:]
    after = [w.lower() for w in _WORDS.findall(text[b : b + 25])][:2]
    digits, letters = _digits(span), sum(c.isalpha() for c in span)
    if kind == "card":
        form = luhn(digits) and len(set(digits)) > 2
    elif kind == "ip":
        form = not any(len(p) > 1 and p[0] == "0" for p in span.split("."))
    elif kind == "phone":
        form = 9 <= len(digits) <= 15 and len(set(digits)) > 2
    elif kind == "email":
        form = letters >= 4
    elif kind == "secret":
        form = len(digits) >= 2 and len(set(span)) >= 8
    else:
        form = "-00-" not in span and not span.endswith("0000")
    # names listed for the kind: 1 if the span has one of them, 0 if that speaks against it, 2 if the list is silent
    if kind == "email":
        gazetteer = int(re.split(r"\.|dot[)\]] ?", span)[-1].strip().lower() in TOP_LEVEL)
    elif kind == "phone":
        gazetteer = int(digits.startswith(_CALLING)) if span.startswith("+") else 2
    elif kind == "card":
        gazetteer = int(digits.startswith(ISSUERS))
    elif kind == "ip":
        gazetteer = 0 if span.split(".")[0] in NO_HOST or span.startswith(("192.168.", "169.254.")) else 2
    elif kind == "secret":
        gazetteer = 1 if span.startswith(_TOKENS) else 2
    else:
        gazetteer = 0 if span.startswith(NO_AREA) else 2
    cue = CUES[kind]
    context = 1 if any(w in cue for w in (*before, *after)) else 0 if any(w in AGAINST for w in before) else 2
    alone = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    edge = 1 if alone else 0
    return (1 if is_base else 2, int(form), gazetteer, context, edge)


def pattern(text: str, a: int, b: int, kind: str, is_base: bool) -> str:
    """Kind, votes, and what labelers do not look at: length, classes of characters, variety of characters, kinds of character in a row, and
    what stands before the span, each in a few classes."""
    span = text[a:b]
    shape = "".join(s for s, has in (("d", any("0" <= c <= "9" for c in span)), ("u", any(c.isupper() for c in span)), ("l", any(c.islower() for c in span))) if has)
    variety = min(3, 4 * len(set(span)) // (b - a + 1))
    turns = min(3, sum(x.isdigit() != y.isdigit() for x, y in zip(span, span[1:], strict=False)) // 2)
    before = text[a - 1 : a]
    front = 0 if not before or before.isspace() else 1 if before in "=:\"'" else 2 if before.isalnum() else 3
    return f"{kind}|{''.join(map(str, votes(text, a, b, kind, is_base)))}|{min(7, (b - a) // 6)}{variety}{turns}{front}|{shape}"


CANDIDATES = "doc_id long, base array<struct<a:long,b:long,kind:string>>, extra array<struct<a:long,b:long,kind:string,pattern:string>>, base_patterns array<string>"


def label(docs: DataFrame) -> DataFrame:
    """Candidates of each document with their patterns, without the text."""
    span = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.string())])
    more = pa.struct([*span, ("pattern", pa.string())])
    types = [pa.int64(), pa.list_(span), pa.list_(more), pa.list_(pa.string())]
    names = ["doc_id", "base", "extra", "base_patterns"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, extras, shapes = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base, extra = candidates(text)
                bases.append([{"a": a, "b": b, "kind": k} for a, b, k in base])
                shapes.append([pattern(text, a, b, k, True) for a, b, k in base])
                extras.append([{"a": a, "b": b, "kind": k, "pattern": pattern(text, a, b, k, False)} for a, b, k in extra])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip((bases, extras, shapes), types[1:], strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, CANDIDATES)


def reliabilities(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Dawid-Skene EM over pattern counts: the probability of each pattern to be private."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kinds = np.array([KINDS.index(k.split("|")[0]) for k in keys])
    vote = np.array([[int(c) for c in k.split("|")[1]] for k in keys])
    voted = np.where(vote == 2, np.nan, vote)
    with np.errstate(all="ignore"):
        p = np.clip(np.nan_to_num(np.nanmean(voted, axis=1), nan=0.5), 0.05, 0.95)
    for _ in range(rounds):
        # M: how often each labeler gives each vote, for each class; labelers start from being right in four of five cases
        rate = np.empty((2, vote.shape[1], 3))
        for y, w in ((0, n * (1 - p)), (1, n * p)):
            for j in range(vote.shape[1]):
                for v in range(3):
                    start = 10 * (0.8 if v == y else 0.2 if v == 1 - y else 0.5)
                    rate[y, j, v] = (w[vote[:, j] == v].sum() + start) / (w.sum() + 15)
        prior = np.array([(1 + (n * p)[kinds == k].sum()) / (2 + n[kinds == k].sum()) for k in range(len(KINDS))])
        # E
        odds = np.log(prior[kinds] / (1 - prior[kinds]))
        for j in range(vote.shape[1]):
            odds = odds + np.log(rate[1, j, vote[:, j]] / rate[0, j, vote[:, j]])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True))


def _features(key: str) -> np.ndarray:
    kind, vote, classes, shape = key.split("|")
    x = [1.0] + [float(kind == k) for k in KINDS]
    x += [float(v == w) for v in vote for w in "01"]
    x += [float(int(c) == k) for c, n in zip(classes, (8, 4, 4, 4), strict=True) for k in range(n)] + [float(c in shape) for c in "dul"]
    return np.array(x)


def train(counts: dict[str, int], rounds: int = 30, ridge: float = 1.0) -> dict[str, float]:
    """The span classifier's probability for each pattern: a logistic model of the patterns' features, fitted by Newton
    steps to the soft labels of EM."""
    if not counts:
        return {}
    soft = reliabilities(counts)
    keys = sorted(counts)
    x = np.array([_features(k) for k in keys])
    y, n = np.array([soft[k] for k in keys]), np.array([counts[k] for k in keys], float)
    n = n / n.mean()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def accepted_patterns(labelled: DataFrame, at_least: float = 0.5) -> list[str]:
    every = labelled.select(F.explode(F.concat("base_patterns", F.col("extra.pattern"))).alias("pattern"))
    counts = {r["pattern"]: r["count"] for r in every.groupBy("pattern").count().collect()}
    return sorted(k for k, p in train(counts).items() if p >= at_least)


def _rank(kind):
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _count_of(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def _joined(spans):
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["a"].alias("a"), _rank(s["kind"]).alias("r"), s["b"].alias("b"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def find(docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """A row per document: counts of the base kinds, digest of the base spans, all spans."""
    labelled = stored(label(docs), "pii")
    accepted = F.array(*[F.lit(k) for k in accepted_patterns(labelled, at_least)]).cast("array<string>")
    extra = F.transform(F.filter("extra", lambda s: F.array_contains(accepted, s["pattern"])), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind")))
    return labelled.select(
        "doc_id",
        *[_count_of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", extra)).alias("spans"),
    )


def redact(docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """``docs`` with each span that is found replaced by its kind in angle brackets; all columns stay. Null text stays null."""
    labelled = stored(label(docs.select("doc_id", "text")).select("base_patterns", "extra"), "pii")
    accepted = frozenset(accepted_patterns(labelled, at_least))
    at = docs.columns.index("text")

    def clean(text: str) -> str:
        base, extra = candidates(text)
        keep = base + [(a, b, k) for a, b, k in extra if pattern(text, a, b, k, False) in accepted]
        out, end = [], 0
        for a, b, k in sorted(keep, key=lambda s: (s[0], -s[1])):
            if b <= end:
                continue
            if a >= end:
                out += [text[end:a], f"<{k.upper()}>"]
            end = b
        return "".join([*out, text[end:]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([None if (t := v.as_py()) is None else clean(t) for v in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    # columns travel under plain names: those of the input may hold dots
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)])
    return docs.toDF(*names).mapInArrow(task, plain).toDF(*docs.columns)
