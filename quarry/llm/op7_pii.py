"""Personal data: base rules plus a gradient-boosted choice among over-generated candidates.

The base rules (e-mail, IPv4 address, card number, telephone number) always stay. Besides them,
high-recall generators propose overlapping spans: spelled-out e-mail addresses, runs of digits with
separators that look like telephone or card numbers, dotted quads with spaces, and long strings of
letters and digits that may be secrets. Boosted trees score each candidate by format and context
features; a threshold per kind, calibrated on held-out candidates for ``precision``, selects what is
added. Candidates that touch a base span are not added again.

The trees are fitted on a bounded sample: about ``sample_docs`` different texts (those whose hash falls
under a threshold, each once however often it repeats), and ``sample_candidates`` candidates of them.
Labels do not come from the base rules. A positive is a base span written in a form that no base rule
accepts, in its place in the text, or a random key put behind the words that keys stand behind; a negative is
a candidate whose context or value speaks against it, a base span put in such a context, or a checksum,
name or version in a key's place. Other candidates off the base spans have no label. A leading + and an
@ are no features, as they define base rules. The calibrated precision is that on held-out labels,
held out by text. Detection covers every document, whole.

Offsets are code points, end exclusive. Edges: a null text is an empty one; repeated rows are
treated alike; null and repeated keys play no part in the sample; an empty table, or a sample without
candidates, adds nothing to the base rules.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import map_arrow, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SAMPLE_DOCS, SAMPLE_CANDIDATES, PRECISION = 20_000, 20_000, 0.98
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behind only spares starts inside a run of digits, which cannot match where its start fails
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[(\[]\s?at\s?[)\]]\s?[A-Za-z0-9-]+(?:\s?(?:\.|[(\[]\s?dot\s?[)\]])\s?[A-Za-z0-9-]+)+", re.I)
NUMBER = re.compile(r"(?<![0-9])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,24}(?![0-9])")
QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?\.\s?[0-9]{1,3}){3}(?![0-9.])")
AT = re.compile(r"[(\[]\s?at\s?[)\]]", re.I)
_AT_BYTES = re.compile(rb"[(\[].{0,3}at.{0,3}[)\]]", re.I | re.S)  # as wide as AT: a space has three bytes at most
AGAINST = re.compile(r"(?i)(?:=|#|\$|€|£|\b(?:key|token|id|no\.?|v|version|order|isbn|sha|part))\W*$")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}(?![A-Za-z0-9_+/=-])")
KEYWORD = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passwd|api[_-]?key|access[_-]?key|private[_-]?key|bearer|auth(?:orization)?)[\"']?\s*(?:[:=]+|\s)\s*[\"']?$")
CHECKSUM = re.compile(r"(?i)(?:sha-?[0-9]*|md5|commit|checksum|digest|etag|revision|hash|uuid|build|file|img|path)[\"']?\s*[:=]?\s*[\"']?$")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")
_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), ord("@"), ord("+")]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest run of local characters before it and a dotted domain after it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub(r"[^0-9]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """High-recall proposals; a run of digits is proposed as telephone and as card number."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    if AT.search(text):
        out += [("email", *m.span()) for m in SPELLED.finditer(text)]
    for m in NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m.group())
        if n <= 15:
            out.append(("phone", *m.span()))
        if n >= 13:
            out.append(("card", m.start() + (m.group()[0] in "+("), m.end()))
    out += [("ip", *m.span()) for m in QUAD.finditer(text)]
    for m in SECRET.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if 2 <= digits and sum(c.isalpha() for c in m.group()) >= 2:
            start = m.start() + (m.group().rfind("=", 0, -2) + 1)  # what an assignment assigns
            if m.end() - start >= 16:
                out.append(("secret", start, m.end()))
    return out


def entropy(span: str) -> float:
    """Bits of each character."""
    counts = np.array(list(Counter(span).values()), float) / max(1, len(span))
    return float(-(counts * np.log2(counts)).sum())


FEATURES = 22


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    # length and digits are format in numbers only: in an address they say nothing of its form
    number = span if kind not in ("email", "secret") else ""
    key = span if kind == "secret" else ""
    digits = "".join(c for c in number if c.isdigit() and c.isascii())
    groups = re.findall(r"[0-9]+", number)
    return [
        float(KINDS.index(kind)), float(len(number)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(span.count(" ")), float(span.count("-")), float(span.count(".")), float(span.count("(")), float(bool(re.search(r"\.\s", span))),
        float(bool(digits) and luhn(digits)), float(all(int(g) <= 255 for g in groups) if groups and len(groups) == 4 and max(map(len, groups)) < 10 else 0),
        float(bool(before) and before[-1].isspace()), float(not after or not (after[0].isalnum() or after[0] in "_=\"'")),
        float(bool(re.search(r"(?i)(mail|tel|phone|call|card|visa|ip|host|contact)\W*$", before))), float(bool(re.search(r"(?i)(=|key|token|id|no\.?|#|v)\W*$", before)) or bool(AGAINST.search(before))),
        float(len(key)), entropy(key) if key else 0.0, float(bool(key) and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", key) is not None), float(bool(key) and KEYWORD.search(before) is not None),
        float(bool(key) and CHECKSUM.search(before) is not None),
    ]


@dataclass
class Trees:
    """Boosted regression trees of depth 2 on the logistic loss, and a threshold per kind."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for root, low, high in self.trees:
            right = x[:, root[0]] > root[1]
            for side, (feature, cut, a, b) in ((~right, low), (right, high)):
                f[side] += np.where(x[side, feature] > cut, b, a)
        return 1 / (1 + np.exp(-f))


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, smooth: float = 1.0) -> tuple[float, int, float, float, float]:
    """(gain, feature, cut, left value, right value) of the best single cut."""
    total_g, total_h = g.sum(), h.sum()
    best = (0.0, 0, np.inf, total_g / (total_h + smooth), 0.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        lg, lh = cg[at], ch[at]
        gain = lg**2 / (lh + smooth) + (total_g - lg) ** 2 / (total_h - lh + smooth) - total_g**2 / (total_h + smooth)
        i = int(np.argmax(gain))
        if gain[i] > best[0] + 1e-9:
            best = (float(gain[i]), j, float(v[at[i]] + v[at[i] + 1]) / 2, float(lg[i] / (lh[i] + smooth)), float((total_g - lg[i]) / (total_h - lh[i] + smooth)))
    return best


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 40, rate: float = 0.3, precision: float = PRECISION) -> Trees:
    """Fits on the rows not held, then sets each kind's threshold on the held ones: the lowest score
    from which on ``precision`` of them are right; a kind that never gets there adds nothing."""
    model = Trees()
    fit_x, fit_y = x[~held], y[~held].astype(float)
    if not len(fit_x) or not 0 < fit_y.sum() < len(fit_y):
        return model
    rate_of = fit_y.mean()
    model.start = float(np.log(rate_of / (1 - rate_of)))
    f = np.full(len(fit_x), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = fit_y - p, p * (1 - p)
        gain, j, cut, _, _ = _best_split(fit_x, g, h)
        if gain <= 1e-6:
            break
        right, leaves = fit_x[:, j] > cut, []
        for side in (~right, right):
            _, jj, c, a, b = _best_split(fit_x[side], g[side], h[side])
            leaves.append((jj, c, rate * a, rate * b))
            f[side] += np.where(fit_x[side, jj] > c, rate * b, rate * a)
        model.trees.append(((j, cut), *leaves))
    score = model.score(x[held])
    for i, kind in enumerate(KINDS):
        own = x[held][:, 0] == i
        order = np.argsort(-score[own], kind="stable")
        s, right = score[own][order], np.cumsum(y[held][own][order])
        good = right >= precision * np.arange(1, len(s) + 1)
        ends = np.append(s[1:] < s[:-1], True) if len(s) else np.empty(0, bool)
        at = np.flatnonzero(good & ends)
        if len(at) and right[at[-1]] >= 10:
            model.thresholds[kind] = float(max(s[at[-1]], 0.5))
    return model


def _checked(digits: str) -> str:
    """digits with its last one replaced so that the Luhn sum is right."""
    return next(d for c in "0123456789" if luhn(d := digits[:-1] + c))


def disguised(kind: str, span: str, r: random.Random) -> str:
    """A base span in a form that its base rule does not accept."""
    if kind == "email":
        opens, shuts = r.choice(["()", "[]"])
        gap, word = r.choice(["", " "]), r.choice([str.lower, str.upper])
        sign = lambda x: f"{gap}{opens}{word(x)}{shuts}{gap}"
        name, _, domain = span.partition("@")
        return name[-64:] + sign("at") + domain.replace(".", r.choice([".", sign("dot")]))
    if kind == "ip":
        return r.choice([" . ", ". ", " ."]).join(str(int(p)) for p in span.split("."))
    if kind == "phone":
        return span.lstrip("+")
    digits = _checked(re.sub(r"[^0-9]", "", span)[: r.choice([13, 14, 15])])
    sign = r.choice(["", " ", "-"])
    return sign.join([digits[:4], digits[4:10], digits[10:]] if r.random() < 0.5 else [digits[i : i + 4] for i in range(0, len(digits), 4)])


def against(text: str, kind: str, start: int, end: int) -> bool:
    """Whether the context or the value speaks against a candidate."""
    span, after = text[start:end], text[end : end + 1]
    if kind == "secret":
        return CHECKSUM.search(text[max(0, start - 24) : start]) is not None
    if AGAINST.search(text[max(0, start - 24) : start]) or after.isalnum() or after in ("_", "%"):
        return True
    if kind == "email":
        return re.search(r"\.\s+[A-Za-z]", span) is not None and re.search(r"(?i)[(\[]\s?dot", span) is None
    if kind == "ip":
        return any(int(g) > 255 for g in re.findall(r"[0-9]+", span))
    if kind == "card":
        return not luhn(re.sub(r"[^0-9]", "", span))
    return DATE.search(span) is not None


def _secrets(text: str, key: int) -> Iterator[tuple[str, int, list[float], bool]]:
    """Random keys and what looks like them, put at a random place of the text."""
    r = random.Random(f"{key} secret")
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    leads = ['token = "', "token: ", 'api_key="', "API_KEY=", "secret = ", "password: ", "Authorization: Bearer ", '"access_key": "', "auth "]
    others = ["sha256:", "commit ", "md5 ", "checksum: ", 'etag: "', "file ", "build ", "revision "]
    word = lambda: r.choice(re.findall(r"[a-z]{3,}", text[:2000]) or ["final"])
    names = [lambda: f"{word()}_{word()}_{word()}_20{r.randint(10, 30)}", lambda: f"{word()}-{word()}-v{r.randint(1, 9)}-{r.randint(1, 99)}-{word()}"]
    for made, lead, label in (
        (r.choice([lambda: hexes(r.choice([32, 40, 64])), lambda: mixed(r.randint(20, 64))])(), r.choice(leads), True),
        (hexes(r.choice([32, 40, 64])), r.choice(others), False),
        (r.choice(names)(), r.choice(["", *leads, *others]), False),
    ):
        at = r.randint(0, len(text))
        at = text.find(" ", at) + 1
        put = text[max(0, at - 200) : at] + lead
        start, quote = len(put), '"' if lead.endswith('"') else ""
        put += made + quote + " " + text[at : at + 100]
        yield from (("secret", at, features(put, k, s, e), label) for k, s, e in candidates(put) if (k, s, e) == ("secret", start, start + len(made)))


def examples(text: str, key: int) -> list[tuple[str, int, list[float], bool]]:
    """(kind, start, features, label) of a text."""
    base, out = base_spans(text), list(_secrets(text, key))
    own = [(s, e) for _, s, e in base]
    for k, s, e in candidates(text):
        if not any(a < e and s < b for a, b in own) and against(text, k, s, e):
            out.append((k, s, features(text, k, s, e), False))
    for kind, start, end in base:
        r = random.Random(f"{key} {kind} {start}")
        before, after = text[max(0, start - 200) : start], text[end : end + 200]
        form = disguised(kind, text[start:end], r)
        bad = {"email": lambda: f"{r.choice(re.findall('[a-z]+', before + after) or ['look'])} (at) {r.choice(re.findall('[a-z]+', after + before) or ['this'])}. Then", "ip": lambda: re.sub("^[0-9]+", str(r.randint(256, 999)), form), "card": lambda: form[:-1] + str((int(form[-1]) + r.randint(1, 9)) % 10), "phone": lambda: r.choice(["2021-03-04 12", "04/03/2021 11"])}
        context = r.choice(["id=", "token: ", "no. ", "order #", "v"])
        for lead, piece, label in ((before, form, True), (before, bad[kind](), False), (before + " " + context, form, False)):
            if label and (AGAINST.search(lead[-24:]) or after[:1].isalnum() or any(x == kind and a < len(lead) + len(piece) and b > len(lead) for x, a, b in base_spans(lead + piece + after))):
                continue
            put = lead + piece + after
            for k, s, e in candidates(put):
                if s < len(lead) + len(piece) and e > len(lead):
                    whole = k == kind and (s, e) == (len(lead), len(lead) + len(piece))
                    # of a right form, only the whole span is right and pieces of it have no label
                    if whole or not label and against(put, k, s, e):
                        out.append((k, start, features(put, k, s, e), label))
    return out


def _sample_kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = []
    for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            rows += [(key, s, k, [*x, float(y)]) for k, s, x, y in examples(text, key)]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.float64()))], ["key", "start", "kind", "x"])


def fit(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> Trees:
    share = min(1.0, sample_docs / max(1, docs.count()))
    part = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where(F.col("t").rlike("[0-9@]")).withColumn("_h", F.xxhash64("t"))
    part = part.where(F.pmod("_h", F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).dropDuplicates(["_h"])
    rows = map_arrow(part.select("t", "_h"), _sample_kernel, "key bigint, start bigint, kind string, x array<double>")
    got = rows.orderBy(F.xxhash64("key", "start", "kind"), "key", "start", "kind", "x").limit(sample_candidates).collect()
    if not got:
        return Trees()
    x = np.array([r["x"] for r in got])
    held = np.array([r["key"] & 1 == 1 for r in got])
    return boost(x[:, :-1], x[:, -1] > 0, held)


def detect(text: str, model: Trees) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by kind and start."""
    base = base_spans(text)
    order = lambda spans: sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    added: list[tuple[str, int, int]] = []
    if model.thresholds:
        own = sorted((s, e) for _, s, e in base)
        free = [c for c in candidates(text) if c[0] in model.thresholds and not any(s < c[2] and c[1] < e for s, e in own)]
        if free:
            score = model.score(np.array([features(text, *c) for c in free]))
            taken: list[tuple[int, int]] = []
            for i in np.argsort(-score, kind="stable"):
                k, s, e = free[i]
                if score[i] >= model.thresholds[k] and not any(a < e and s < b for a, b in taken):
                    taken.append((s, e))
                    added.append((k, s, e))
    return order(base), order(base + added)


def _detect_kernel(model: Trees):
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    empty = hashlib.sha256(b"").hexdigest()

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in K.slices(batch, "_text", 8 << 20):
            total = np.concatenate(([0], np.cumsum(_MARK[data], dtype=np.int64)))
            marked = (total[offsets[1:]] - total[offsets[:-1]]) > 0
            counts, added, digests, spans = np.zeros((4, rows.num_rows), np.int64), np.zeros(rows.num_rows, np.int64), [empty] * rows.num_rows, [""] * rows.num_rows
            raw = data.tobytes()
            for i in range(rows.num_rows):
                piece = raw[offsets[i] : offsets[i + 1]]
                if not marked[i] and not _AT_BYTES.search(piece):
                    continue
                base, every = detect(piece.decode("utf-8", "replace"), model)
                for k, _, _ in base:
                    counts[BASE.index(k), i] += 1
                if base:
                    digests[i] = hashlib.sha256(join(base).encode()).hexdigest()
                spans[i], added[i] = join(every), len(every) - len(base)
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], *(pa.array(c) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added), pa.array(added + counts.sum(0))], [*rows.schema.names[1:], *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "n_spans"])

    return kernel


def find(docs: DataFrame, model: Trees, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans), one row per row of docs."""
    slim = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{key}`").alias("_key"))
    kind = slim.schema["_key"].dataType.simpleString()
    out = map_arrow(slim, _detect_kernel(model), f"_key {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string, n_added bigint, n_spans bigint")
    return out.withColumnRenamed("_key", key)


def redact(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans merge."""
    merged: list[list] = []
    for k, s, e in sorted((p.split(":") for p in spans.split(",") if p), key=lambda p: int(p[1])):
        if merged and int(s) < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], int(e))
        else:
            merged.append([k, int(s), int(e)])
    out, at = [], 0
    for k, s, e in merged:
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
