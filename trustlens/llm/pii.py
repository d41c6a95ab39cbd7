"""Personal data by weak supervision.

Plain patterns find e-mail addresses, IP addresses, card and phone numbers; these spans always
stay. A wider net adds candidates that the patterns miss or spoil: numbers that run into one
another, phones without a plus, spelled-out addresses. Six labelers vote on every candidate
(for, against, or not at all): the pattern, the number's structure and checksum, gazetteers
(calling codes, card issuers, top-level domains), words of context for and against, and what the
span touches. Votes of all documents are counted by kind and pattern; expectation-maximisation
over these counts estimates each labeler's reliability and every pattern's probability; a
logistic classifier over votes and shape, trained on them, decides the candidates.

The counts have at most 4 * 3**6 * 20 rows whatever the corpus, so they may go to the driver; texts
never do.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlens.llm.common import ready, source, written

KINDS = ("email", "ip", "card", "phone")
#: probability at which a candidate becomes a span
DECISION = 0.9

# fixed values: gazetteers (public calling codes, issuer prefixes, common top-level domains)
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
                 "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84",
                 "86", "90", "91", "92", "98", "351", "352", "353", "358", "420", "421", "971", "972")
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "6011", "65", "35", "36", "38", "62")
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "uk", "us", "nl", "ch", "at")
FOR = {"email": ("mail", "e-mail", "email", "contact", "write", "correo", "courriel", "contacto", "kontakt", "schreiben"),
       "ip": ("ip", "address", "host", "server", "adresse", "login", "from", "client"),
       "card": ("card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte", "kreditkarte", "account"),
       "phone": ("tel", "phone", "call", "mobile", "fax", "cell", "telefon", "telefono", "teléfono", "téléphone", "number")}
AGAINST = ("version", "v", "ver", "release", "isbn", "issn", "order", "invoice", "id", "license", "section", "art", "page",
           "chapter", "ref", "serial", "sha", "hash", "token", "key", "password")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ATOM = re.compile(r"(?<![A-Za-z0-9])\+?\(?[0-9]++(?:[().-]{1,2}[0-9]++)*+\)?(?![A-Za-z0-9])")
_SPELLED = re.compile(r"\b([a-z0-9_+-]{1,64}(?:\.[a-z0-9_+-]{1,64}){0,5})\s?(?:[\[({]\s?(?:at|@)\s?[\])}]|\sat\s)\s?"
                      r"([a-z0-9-]{1,63}(?:(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s{1,2}dot\s{1,2}|\s\.\s|\.)[a-z0-9-]{1,63}){1,4})", re.I)
#: what every spelled-out address holds: its sign and what follows, up to the first dot
_AT = re.compile(r"(?:[\[({]\s?(?:at|@)\s?[\])}]|\sat\s)\s?[a-z0-9-]{1,63}\s?(?:[\[({]\s?(?:dot|\.)\s?[\])}]|\sdot\s|\.)\s?[a-z0-9-]", re.I)
_BRACKET_OR_DOT = re.compile(r"[\[({]|\sdot\s", re.I)
_WORD_BEFORE = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain patterns, kind by kind."""
    out, done, seen = [], 0, 0
    at = text.find("@")
    while at >= 0:  # the local part is what stands before the sign, back to the last match or sign
        begin = max(done, seen)
        local = _LOCAL.match(text[begin:at][::-1])
        domain = _DOMAIN.match(text, at + 1)
        if local and domain:
            out.append((0, at - local.end(), domain.end()))
            done = domain.end()
        seen = at + 1
        at = text.find("@", max(done, at + 1))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def _runs(text: str):
    """Runs of number atoms that stand one space apart."""
    run = []
    for m in _ATOM.finditer(text):
        if run and not (m.start() == run[-1][1] + 1 and text[run[-1][1]] == " "):
            yield run
            run = []
        run.append((m.start(), m.end(), _digits(m[0])))
    if run:
        yield run


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the plain patterns, none overlapping a base span or one another."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    out: list[tuple[int, int, int]] = []
    own: list[tuple[int, int]] = []  # the spans in ``out``, sorted; they do not overlap

    def free(s: int, e: int) -> bool:
        i, j = bisect_left(starts, e), bisect_left(own, (e,))
        return not (i and taken[i - 1][1] > s) and not (j and own[j - 1][1] > s)

    def add(kind: int, s: int, e: int) -> None:
        out.append((kind, s, e))
        insort(own, (s, e))

    for run in _runs(text):
        i = 0
        while i < len(run):
            best, digits = None, ""
            for j in range(i, len(run)):  # as far as the digits of a number reach
                digits += run[j][2]
                piece = text[run[i][0]:run[j][1]]
                if len(digits) > 19:
                    break
                if piece[0] == "+" or piece[0] == "(":
                    if (8 if piece[0] == "+" else 10) <= len(digits) <= 15 and "+" not in piece[1:]:
                        best = (3, run[i][0], run[j][1], j)
                elif "+" in piece or "(" in piece:
                    break
                elif 16 <= len(digits) <= 19 and "." not in piece and luhn(digits):
                    best = (2, run[i][0], run[j][1], j)
                elif 10 <= len(digits) <= 11 and j > i - 1 and re.fullmatch(r"(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}", piece):
                    best = (3, run[i][0], run[j][1], j)
            if best and free(best[1], best[2]):
                add(*best[:3])
                i = best[3] + 1
            else:
                i += 1
    if _AT.search(text):
        for m in _SPELLED.finditer(text):
            if free(m.start(), m.end()):
                add(0, m.start(), m.end())
    return out


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The six labelers: 1 for, 2 against, 0 no opinion."""
    piece = text[start:end]
    digits = _digits(piece)
    words = [w.lower() for w in _WORD_BEFORE.findall(text[max(0, start - 40):start])][-3:]
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9-]+", piece.rstrip(")]}"))[-1].lower()
        structure = 1 if 2 <= len(last) <= 24 and last.isalpha() else 2
        listed = 1 if last in TOP_LEVEL else 0
        if not base and not _BRACKET_OR_DOT.search(piece):  # plain words around "at" and a full stop: prose, as a rule
            structure, listed = 2 if re.search(r"\.\s", piece) else 0, listed or 2
    elif kind == 1:
        parts = piece.split(".")
        structure = 2 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        listed = 2 if parts[0] in ("0", "255") else 0
    elif kind == 2:
        structure = 1 if 16 <= len(digits) <= 19 and luhn(digits) else 2
        listed = 1 if digits.startswith(ISSUERS) else 2
    else:
        structure = 1 if 10 <= len(digits) <= 13 else 0 if 8 <= len(digits) <= 15 else 2
        listed = (1 if digits.startswith(CALLING_CODES) else 2) if piece[0] == "+" else 0
    touches = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_=/#")) or (
        end < len(text) and (text[end].isalnum() or text[end] in "_=/"))
    return (1 if base else 0, structure, listed, 1 if any(w in FOR[KINDS[kind]] for w in words) else 0,
            2 if any(w in AGAINST for w in words) else 0, 2 if touches else 1)


def _code(vote: tuple[int, ...]) -> int:
    n = 0
    for v in vote:
        n = 3 * n + v
    return n


def candidates(text: str):
    """(base spans, [(kind, start, end, votes, shape, base)])"""
    base = base_spans(text)
    wide = wide_spans(text, base)
    found = [(k, s, e, _code(votes(text, k, s, e, b)), len(_digits(text[s:e])) % 20, b)
             for b, spans in ((True, base), (False, wide)) for k, s, e in spans]
    return base, found


# ------------------------------------------------------------------ reliabilities and classifier

def _one_hot(code: np.ndarray, labelers: int = 6) -> np.ndarray:
    out = np.zeros((len(code), labelers, 3))
    for i in range(labelers):
        out[np.arange(len(code)), labelers - 1 - i, code // 3**i % 3] = 1
    return out


def reliabilities(code: np.ndarray, n: np.ndarray, steps: int = 100):
    """Expectation-maximisation over vote patterns of one kind (n: how often each occurs).
    Returns (share of true candidates, P(vote | true / false) [2, labelers, 3], P(true | pattern))."""
    x = _one_hot(code)
    # to begin with, a labeler is right three times in four when it speaks; one pseudo count each
    prior = np.stack([np.tile([0.5, 1.5, 0.5], (6, 1)), np.tile([0.5, 0.5, 1.5], (6, 1))])
    p = np.tile([0.4, 0.45, 0.15], (6, 1))
    theta, share = np.stack([p, p[:, [0, 2, 1]]]), 0.5
    for _ in range(steps):
        like = np.einsum("ijk,cjk->ic", x, np.log(theta)) + np.log([share, 1 - share])
        true = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -50, 50)))
        weight = np.stack([true * n, (1 - true) * n])
        counts = np.einsum("ci,ijk->cjk", weight, x) + prior
        theta = counts / counts.sum(2, keepdims=True)
        share = float(np.clip((weight[0].sum() + 1) / (n.sum() + 2), 1e-3, 1 - 1e-3))
    return share, theta, true


def _features(kind: np.ndarray, code: np.ndarray, shape: np.ndarray) -> np.ndarray:
    x = _one_hot(code)[:, 1:, 1:].reshape(len(code), -1)  # the pattern's own vote is no feature
    own = np.eye(len(KINDS))[kind]
    size = np.stack([shape / 10, (shape / 10) ** 2], 1)
    return np.concatenate([own, x, own[:, 2:3] * size, own[:, 3:4] * size], 1)


def fit(counts) -> np.ndarray:
    """Classifier weights from rows (kind, votes, shape, n) of the whole corpus."""
    kind, code, shape, n = (np.array([r[i] for r in counts], np.int64) for i in range(4))
    width = _features(np.zeros(1, int), np.zeros(1, int), np.zeros(1, int)).shape[1]
    w = np.zeros(width)
    if not len(n):
        return w
    target = np.zeros(len(n))
    for k in range(len(KINDS)):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            target[rows] = reliabilities(code[rows], n[rows].astype(float))[2]
    x, weight = _features(kind, code, shape), n.astype(float)
    for _ in range(50):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - 0.1 * w
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w = w + step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
    return w


def decide(found, w: np.ndarray) -> list[tuple[int, int, int]]:
    """All base spans and the candidates that the classifier takes, by kind and start."""
    spans = [(k, s, e) for k, s, e, _, _, b in found if b]
    wide = [c for c in found if not c[5]]
    if wide:
        kind, code, shape = (np.array([c[i] for c in wide]) for i in (0, 3, 4))
        p = 1 / (1 + np.exp(-np.clip(_features(kind, code, shape) @ w, -30, 30)))
        spans += [c[:3] for c, take in zip(wide, p >= DECISION, strict=True) if take]
    return sorted(spans)


def span_string(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# ------------------------------------------------------------------ Spark passes

_FOUND = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
          "found array<struct<kind:int,start:long,stop:long,votes:int,shape:int,base:boolean>>")
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("votes", pa.int32()),
                                   ("shape", pa.int32()), ("base", pa.bool_())]))
_NOTHING = hashlib.sha256(b"").hexdigest()
_MAY = re.compile(rb"[0-9@]|(?i:\bat\b)")


def _found(batches):
    for batch in batches:
        texts, n = batch.column("text"), batch.num_rows
        counts, sums, found = np.zeros((n, len(KINDS)), np.int64), [_NOTHING] * n, [[]] * n
        for i in range(n):
            raw = texts[i].as_buffer() if texts[i].is_valid else b""
            if raw is None or not _MAY.search(raw):
                continue
            base, all_ = candidates(texts[i].as_py())
            for k, _, _ in base:
                counts[i, k] += 1
            if base:
                sums[i] = hashlib.sha256(span_string(base).encode()).hexdigest()
            found[i] = [dict(zip(("kind", "start", "stop", "votes", "shape", "base"), c, strict=True)) for c in all_]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(KINDS))),
                                          pa.array(sums), pa.array(found, _FOUND_ARROW)],
                                         names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "found"])


def vote_counts(found: DataFrame) -> list:
    """How often each (kind, votes, shape) occurs: a bounded number of rows."""
    rows = found.select(F.explode("found").alias("c"))
    return rows.groupBy("c.kind", "c.votes", "c.shape").agg(F.count(F.lit(1)).alias("n")).collect()


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    docs: doc_id and text; further columns are ignored. Counts and hash are of the base spans; a null
    or empty text has none. Repeated rows give a row each, an empty table none.
    """
    ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = written(texts.mapInArrow(_found, _FOUND), "found")
    w = fit(vote_counts(found))

    def decided(batches):
        for batch in batches:
            rows = [[tuple(c.values()) for c in row] for row in batch.column("found").to_pylist()]
            spans = [decide(row, w) if row else [] for row in rows]
            added = [len(s) - sum(c[5] for c in row) for s, row in zip(spans, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([span_string(s) for s in spans], pa.string()),
                                              pa.array(added, pa.int64())], names=[*batch.schema.names[:6], "spans", "n_added"])
    return found.mapInArrow(decided, _FOUND.split(", found")[0] + ", spans string, n_added long")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in angle brackets; other
    columns and texts without spans are as they were (``n_chars``, where there is one, follows)."""
    ready(docs.sparkSession)
    found = written(docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(_found, _FOUND)
                    .filter(F.size("found") > 0).select("found"), "found")
    w = fit(vote_counts(found))

    def cleaned(batches):
        for batch in batches:
            texts, out = batch.column("text"), []
            for x in texts:
                raw = x.as_buffer() if x.is_valid else b""
                out.append(x.as_py() if raw is None or not _MAY.search(raw) else _without(x.as_py(), decide(candidates(x.as_py())[1], w)))
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, "text", pa.array(out, texts.type))
            yield batch
    out = docs.mapInArrow(cleaned, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _without(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if e <= at:
            continue
        out += [text[at:max(at, s)], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_pii(source(spark, sf_dir, "documents", "doc_id", "text"))
