"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) come from fixed rules and always stay. Further spans come from candidates
outside base spans: longer tokens with a digit, the value after a gazetteer word or an assignment (of any length, with
or without digits), numbers whose groups blanks, dots, dashes or brackets part, hardware and version 6 addresses, and
dates of birth. Names of persons and postal addresses are not proposed. Labelers vote on each (its form by regular expressions, words of a
gazetteer before it, the characters around it, its mix of characters); they may abstain. Expectation-maximisation over
the counts of all vote patterns of the corpus estimates how reliable each labeler is, and a logistic span classifier is
trained on the resulting probabilities with the votes and the form of the candidate as features. Candidates that it
accepts are spans of kind secret or number.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sigwarn.llm.store import id_of_any_name
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]
#: A candidate is a span when the classifier's probability is at least this.
THRESHOLD = 0.5
#: Bounds of how often a labeler is right, and of the share of candidates that are personal data.
RIGHT, SHARE = (0.6, 0.95), (0.2, 0.5)
#: Characters before and after a candidate that the context labelers see.
CONTEXT = 24
#: Newton's steps that train the classifier.
STEPS = 25

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{9,}=*")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Words that announce credentials or numbers of persons, in the four languages of interest.
SECRET_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "credential", "passwort", "kennwort", "mot de passe", "contraseña", "clave")
NUMBER_WORDS = ("ssn", "social security", "passport", "iban", "account no", "account number", "phone", "tel", "telefon", "teléfono", "téléphone", "reisepass", "pasaporte", "passeport")
_SECRET_WORD = re.compile("|".join(map(re.escape, SECRET_WORDS)), re.I)
_NUMBER_WORD = re.compile(r"\b(?:" + "|".join(map(re.escape, NUMBER_WORDS)) + r")\b", re.I)
_KEY_FORM = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[bp]-)[A-Za-z0-9_-]{12,}\Z|[0-9a-f]{16,}\Z")
_NUMBER_FORM = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}\Z|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z")
_ASSIGN = re.compile(r"[=:]\s*[\"']?\Z")
# A value: in quotes up to the closing one, else up to a blank (the pattern takes its first character, _VALUE_END finds
# its end); after a word and a verb, an assignment or a blank, or after any assignment. Values have any length.
_QUOTED = r"\"(?P<q>[^\"\n]+)\"|'(?P<s>[^'\n]+)'|(?P<v>[^\s\"'`<>])"
_VALUE_END = re.compile(r"[\s\"'`<>]")
_GIVEN = r"[\"']?(?:[ \t]*(?P<sign>[:=]+>?)[ \t]*\n?[ \t]*|[ \t]+(?:is|ist|lautet|es|est|no\.?|nr\.?|number)\b[ \t]*(?P<verb>:?)[ \t]*|\.?[ \t]+)"
_WORDS = "|".join(re.escape(w) for w in sorted(SECRET_WORDS + NUMBER_WORDS, key=len, reverse=True))
_AFTER_WORD = re.compile(rf"(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z])(?=[A-Z])))(?P<word>{_WORDS})(?![^\W_]){_GIVEN}(?:{_QUOTED})", re.I)
_AFTER_SIGN = re.compile(rf"(?:=|:(?=[ \t\"']))[ \t]*(?:{_QUOTED})")
_GROUPS = re.compile(r"(?<![\w.+-])[(\[]?[0-9](?:[ ().\[\]/-]{0,2}[0-9])+(?![\w-])")
_GROUP_FORM = re.compile(r"[(\[]?[0-9]{3}[)\]][ .-]?[0-9]{3}[ .-][0-9]{4}\Z|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}\Z|[(\[]?0[0-9]{1,4}[)\]]?[ /-][0-9]{3,}(?:[ -][0-9]{2,})*\Z|[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}\Z")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Forms that nothing else has, hardware and version 6 addresses, and dates after a word for birth.
_HARDWARE = r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}"
_ADDRESS = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
_OWN_FORM = re.compile(rf"(?<![0-9A-Za-z:.-])(?:{_HARDWARE}|{_ADDRESS})(?![0-9A-Za-z:-])")
BIRTH_WORDS = ("date of birth", "born on", "born", "dob", "geburtsdatum", "geboren am", "geb.", "date de naissance", "né le", "née le", "fecha de nacimiento", "nacido el", "nacida el")
_BORN = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, BIRTH_WORDS))})[ \t]*:?[ \t]*([0-9]{{1,2}}([./-])[0-9]{{1,2}}\2[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}\.? \w{{3,10}},? [0-9]{{4}}|\w{{3,10}} [0-9]{{1,2}}, [0-9]{{4}})(?![0-9])", re.I)
#: What stands where a value would, but is none: calls, placeholders, masks and words of programs.
_NO_VALUE = re.compile(r"[\w.]+\(|\$[({]|%\(|\{\{|//|(?:none|null|nil|true|false|required|optional|string|str)\Z|[*x.…_-]+\Z", re.I)
LABELERS = ("form", "gazetteer", "assignment", "mixture", "digits")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        start = at
        if host:
            while start > last and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, host.end()
                last = host.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start, in code points."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-18:]) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _values(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, kind, after a word) of values; kind number after a word for numbers, which must hold a digit."""
    for pattern in (_AFTER_WORD, _AFTER_SIGN):
        if pattern is _AFTER_WORD:
            low = text.lower()
            if not any(w in low for w in SECRET_WORDS + NUMBER_WORDS):
                continue
        elif "=" not in text and ":" not in text:
            continue
        at, run_end = 0, -1
        while m := pattern.search(text, at):
            if pattern is _AFTER_SIGN and not text[max(0, m.start() - 4) : m.start()].rstrip(" \t\"'")[-1:].isalnum():
                at = m.start() + 1
                continue
            a, b = m.span(next(g for g in "qsv" if m.group(g) is not None))
            # the value may itself be a word before another value
            at = max(a, m.start() + 1)
            if m.group("v"):
                if a >= run_end:
                    end = _VALUE_END.search(text, a)
                    run_end = end.start() if end else len(text)
                b = run_end
                while b > a and text[b - 1] in ".,;:!?)]}":
                    b -= 1
            if a < b and not _NO_VALUE.match(text, a, b):
                if pattern is _AFTER_SIGN:
                    at = b
                word = m.groupdict().get("word")
                kind = "number" if word and not _SECRET_WORD.fullmatch(word) else "secret"
                if kind == "secret" or _DIGIT.search(text, a, b):
                    yield a, b, kind, bool(word)


def _groups(text: str) -> Iterator[tuple[int, int]]:
    """Numbers in groups: account numbers whose check digits are right, and 7 to 15 digits parted by blanks or signs."""
    for m in _IBAN.finditer(text):
        s = m.group()
        while " " in s and not _iban(s):
            s = s[: s.rindex(" ")]
        if " " in s:
            yield m.start(), m.start() + len(s)
    for m in _GROUPS.finditer(text):
        if 7 <= sum("0" <= c <= "9" for c in m.group()) <= 15 and not m.group().isdigit():
            yield m.span()


def _meeting(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Those of sorted spans without overlaps that overlap a to b."""
    k = bisect_left(spans, (a, a))
    k -= k > 0 and spans[k - 1][1] > a
    out = []
    while k < len(spans) and spans[k][0] < b:
        out.append(spans[k])
        k += 1
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pattern) of the candidates outside base spans; pattern: a vote of each labeler (+, -, 0) and two form features.

    Candidates don't overlap: grouped numbers go first, then tokens, then values; but a value after a word replaces
    what lies within it.
    """
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    found: dict[tuple[int, int], tuple[str, str, bool]] = {}
    held: list[tuple[int, int]] = []

    def add(a: int, b: int, origin: str, kind: str, word: bool = False) -> None:
        if _meeting(taken, a, b):
            return
        inner = _meeting(held, a, b)
        if inner and not (word and (a, b) not in found and all(a <= x and y <= b for x, y in inner)):
            return
        for s in inner:
            del found[s]
            held.remove(s)
        found[a, b] = (origin, kind, word)
        insort(held, (a, b))

    if _DIGIT.search(text):
        if ":" in text or "-" in text:
            for m in _OWN_FORM.finditer(text):
                add(*m.span(), "form", "number")
        for m in _BORN.finditer(text):
            add(*m.span(1), "form", "number", True)
        for s in _groups(text):
            add(*s, "group", "number")
        for m in _CANDIDATE.finditer(text):
            add(*m.span(), "token", "")
    for a, b, kind, word in _values(text):
        add(a, b, "value", kind, word)
    out = []
    for (a, b), (origin, kind, word) in sorted(found.items()):
        s, before = text[a:b], text[max(0, a - CONTEXT) : a]
        digits = sum("0" <= c <= "9" for c in s)
        only = digits == sum(c not in "-/+_=" for c in s)
        kind = kind or ("number" if only or _NUMBER_FORM.match(s) else "secret")
        known = _KEY_FORM.match(s) if kind == "secret" else _NUMBER_FORM.match(s)
        word = word or (_SECRET_WORD if kind == "secret" else _NUMBER_WORD).search(before)
        upper, lower = any("A" <= c <= "Z" for c in s), any("a" <= c <= "z" for c in s)
        mixed = (upper or lower) and 0.1 <= digits / len(s) <= 0.9
        form, mixture, alone = "+" if known else "-", "+" if mixed and len(s) >= 16 else "0" if known else "-", "-" if only or len(s) > 128 else "0"
        # a value without a word or a sign before it is likely none; tokens and grouped numbers stand alone as well
        none = "-" if origin == "value" else "0"
        if origin == "token" and word and _ASSIGN.search(before):
            # an announced value needs no form of its own
            form, mixture = form.replace("-", "0"), mixture.replace("-", "0")
        if origin == "group":
            # the mix of characters says nothing here; check digits and brackets tell more than the form does
            sure = s[0].isalpha() or _GROUP_FORM.match(s) and s[0] in "(["
            form = "+" if s[0].isalpha() or _GROUP_FORM.match(s) else "0" if digits == 7 and word else "-"
            mixture, alone = "0", "+" if sure else "0"
        elif origin == "form":
            form, mixture, alone = "+", "0", "+"
        elif origin == "value":
            # a plain word may be a password, where a word and a sign announce one
            form, mixture = "+" if known else "0", "+" if mixed and len(s) >= 16 else "-" if s.isalpha() and not (word and _ASSIGN.search(before)) else "0"
            alone = "-" if not word and (only or len(s) > 128) else "0"
        votes = "".join((form, "+" if word else none, "+" if _ASSIGN.search(before) else none, mixture, alone))
        out.append((kind, a, b, f"{votes}{min(3, len(s) // 12)}{int(4 * digits / len(s))}"))
    return out


#: Votes that labelers may cast, and the features of a candidate's form at the end of a pattern: its length and its share of digits.
VOTES, LENGTHS, DIGITS = "+-0", 4, 5


class Model:
    """The trained span classifier: a weight for each vote of each labeler and for the form; scores any pattern."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self._seen = weights, {}

    def __call__(self, pattern: str) -> float:
        if pattern not in self._seen:
            self._seen[pattern] = float(1 / (1 + np.exp(-_inputs([pattern])[0] @ self.weights)))
        return self._seen[pattern]


def _inputs(patterns: list[str]) -> np.ndarray:
    votes = np.array([[VOTES.index(c) for c in p[: len(LABELERS)]] for p in patterns]).reshape(len(patterns), len(LABELERS))
    form = np.array([[int(p[-2]) / (LENGTHS - 1), int(p[-1]) / (DIGITS - 1)] for p in patterns]).reshape(len(patterns), 2)
    return np.concatenate([np.ones((len(patterns), 1)), votes == 0, votes == 1, form], axis=1).astype(np.float64)


def estimate(patterns: dict[str, float], rounds: int = 50) -> Model:
    """The classifier trained on the counts of vote patterns.

    Two latent classes, labelers independent in each; expectation-maximisation on the counts of the patterns, from a
    start in which labelers are right four times in five. An abstention tells nothing, and every labeler is right more
    often than not but never sure (RIGHT), in both classes: so neither the classes nor one labeler's say depend on
    which kinds of candidates are many. The reliabilities give every possible pattern, seen or not, a class
    probability; logistic regression is trained on these, half of its rows' weight on the patterns as they are frequent, half on
    all that can be. Without any counts the start is what it learns from.
    """
    names = sorted(patterns)
    votes = _inputs(names)[:, 1 : 1 + 2 * len(LABELERS)].reshape(len(names), 2, len(LABELERS))
    count = np.array([patterns[n] for n in names], dtype=np.float64)
    right, prior = np.full((2, len(LABELERS)), 0.8), 0.4

    def posterior(votes: np.ndarray) -> np.ndarray:
        agrees, against = votes[:, ::-1].transpose(1, 0, 2), votes.transpose(1, 0, 2)
        log = (agrees * np.log(right)[:, None] + against * np.log(1 - right)[:, None]).sum(2) + np.log([1 - prior, prior])[:, None]
        return 1 / (1 + np.exp(log[0] - log[1]))

    for _ in range(rounds if names else 0):
        weight = np.stack([1 - posterior(votes), posterior(votes)]) * count
        prior = float(np.clip((weight[1].sum() + 0.8) / (count.sum() + 2), *SHARE))
        good = (weight[:, :, None] * votes[:, ::-1].transpose(1, 0, 2)).sum(1)
        bad = (weight[:, :, None] * votes.transpose(1, 0, 2)).sum(1)
        right = np.clip((good + 4) / (good + bad + 5), *RIGHT)
    every = ["".join(v) + f"{n}{d}" for v in product(VOTES, repeat=len(LABELERS)) for n in range(LENGTHS) for d in range(DIGITS)]
    x, share = _inputs(every), np.full(len(every), 0.5 / len(every))
    held = posterior(x[:, 1 : 1 + 2 * len(LABELERS)].reshape(len(every), 2, -1))
    if names:
        place = {p: k for k, p in enumerate(every)}
        np.add.at(share, [place[n] for n in names], 0.5 * count / count.sum())
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x.T * (share * p * (1 - p))) @ x + 1e-4 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (share * (p - held)) + 1e-4 * w)
    return Model(w)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The classifier learnt from the vote patterns of all candidates of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                t = text.as_py() or ""
                seen.update(c[3] for c in candidates(t, base_spans(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    # patterns are three votes of five labelers and 4 * 5 forms: a bounded table
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return estimate({r["pattern"]: r["n"] for r in found.collect()})


def all_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and with them the accepted candidates, by kind and start."""
    base = base_spans(text)
    more = [(k, a, b) for k, a, b, p in candidates(text, base) if model(p) >= THRESHOLD]
    return base, base + sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))


@id_of_any_name("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row.

    spans is kind:start:end by kind (KINDS) and start, comma-joined; base_sha256 is the digest of the same of the base
    kinds. Null texts count as empty: no spans. Null ids stay null; repeated rows are searched each. An empty table
    gives an empty result; other columns are not looked at.
    """
    model = fit(docs, text_col) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in pc.fill_null(batch.column(1), ""):
                base, found = all_spans(text.as_py(), shared.value)
                n = Counter(k for k, _, _ in base)
                rows.append((*[n[k] for k in BASE], hashlib.sha256(line(base).encode()).hexdigest(), line(found), len(found) - len(base)))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=[id_col, *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added"])

    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def redacted(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, then the longest, counts."""
    out, at = [], 0
    for k, a, b in sorted(all_spans(text, model)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, model: Model | None = None) -> DataFrame:
    """docs with the personal data in text_col replaced by its kind, and chars_col, if named, set to the new length.

    Null texts stay null and keep their chars_col, empty ones stay empty. Repeated rows are cleaned each. An empty table
    gives an empty result, by a classifier that learnt from no candidate; columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col) if model is None else model)

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield column.map(lambda t: redacted(t, shared.value), na_action="ignore")

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if chars_col:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(docs.schema[chars_col].dataType))
    return out
