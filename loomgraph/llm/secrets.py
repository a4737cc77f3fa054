"""Secret scans: patterns find candidates, a random forest removes false positives.

Features are a candidate's length, character transitions, dictionary coverage, its path and the
words beside it.  The forest is trained from labelled findings.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, column, slices

#: Candidates: values assigned to telling names (see telling), and long runs (kept if they have a digit or mixed case).
ASSIGNED = re.compile(r"(?<!\w)(\w[\w-]*+)[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?(?=([^\s\"',;]{8,}))")
TELLING = frozenset("password passwd passphrase pwd secret token auth credential apikey accesskey secretkey privatekey".split())
TELLING_KEYS = frozenset("api access private secret signing encryption".split())
_ENDS = tuple(sorted(TELLING - {"auth"}))
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
LONG = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}={0,2}")
#: Words before or after a candidate that speak for or against a secret.
FOR = frozenset("token secret key apikey api_key password passwd pwd auth authorization bearer credential credentials private access session cookie jwt signature".split())
AGAINST = frozenset("sha sha1 sha256 md5 digest checksum hash commit revision integrity etag uuid guid id example sample dummy placeholder test card phone order invoice isbn doi http https www mail email file image version build".split())
DICTIONARY = frozenset("""the and for with that this from your you are not have example test sample user name mail file image data server client http https www com net org info index page home login admin
config default value string number public private key token secret password access account address system service project version release build update download upload image images static assets content
common module package class function method object array table column query select insert delete result error warning message event action button label title header footer section style script source target
change create remove replace search filter sort group order count total sum average""".split())  # fmt: skip
TRANSITIONS = ("ll", "lu", "ld", "lo", "ul", "uu", "ud", "uo", "dl", "du", "dd", "do", "ol", "ou", "od", "oo")
_KINDS = np.full(128, 3, np.uint8)  # lower case, upper case, digits, others
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")):
    _KINDS[[ord(c) for c in _chars]] = _k
_TEST_PATH = re.compile(r"(?i)(test|example|sample|mock|fixture|spec|doc)s?\b")
_LOCK_PATH = re.compile(r"(?i)(\.lock|lock\.json|\.sum|\.svg|\.map|\.md)$")
_NOT_HEXA = re.compile(r"[^0-9a-fA-F]")
_NEAR = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
CONTEXT = 48


def telling(name: str) -> bool:
    """Whether a part of an identifier in snake, kebab or camel case tells of a secret, alone
    (db_password), at the end of a run of words (authtoken) or with the next part (API_KEY)."""
    parts = [p.lower() for p in _PART.findall(name)]
    parts = [p[:-1] if p.endswith("s") and p[:-1] in TELLING else p for p in parts]
    if any(p in TELLING or p.endswith(_ENDS) for p in parts):
        return True
    return any(a in TELLING_KEYS and b in ("key", "keys") for a, b in zip(parts, parts[1:]))


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans (start, end) of candidates in the whole text, in order and without overlap."""
    if not text:
        return []
    found = [m.span(2) for m in ASSIGNED.finditer(text) if telling(m[1])] if ("=" in text or ":" in text) else []
    for m in LONG.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) or (s != s.lower() and s != s.upper()):
            found.append(m.span())
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        while b > a and text[b - 1] in ".,":
            b -= 1
        if b - a >= 8 and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


@lru_cache(maxsize=4)
def _words_in(dictionary: frozenset[str]) -> re.Pattern:
    """Finds words of three letters and more from left to right, the longest first."""
    words = sorted((w for w in dictionary if len(w) > 2), key=lambda w: (-len(w), w))
    return re.compile("|".join(map(re.escape, words)) or r"(?!)")


def coverage(s: str, dictionary: frozenset[str] = DICTIONARY) -> float:
    """Share of the characters that dictionary words of three letters and more cover."""
    return sum(map(len, _words_in(dictionary).findall(s.lower()))) / max(len(s), 1)


def features(secret: str, before: str, after: str, path: str | None, dictionary: frozenset[str] = DICTIONARY) -> list[float]:
    """Length, entropy, class shares and transitions, coverage, path and neighbouring words, of the
    whole candidate."""
    codes, n = code_points(secret), len(secret)
    kinds = _KINDS[np.minimum(codes, 127)]
    shares = np.bincount(kinds, minlength=4) / n
    moves = np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16) / max(n - 1, 1)
    seen = np.unique(codes, return_counts=True)[1] / n
    near = _NEAR.findall(before)[-3:] + _NEAR.findall(after)[:1]
    parts = {p for w in near for p in [w.lower(), *w.lower().split("_"), *(x.lower() for x in _PART.findall(w))]}
    return [
        math.log(n), float(-(seen * np.log2(seen)).sum()), *shares.tolist(), *moves.tolist(), coverage(secret, dictionary),
        float(not _NOT_HEXA.search(secret)), float(secret.isdigit()), secret.count(".") / n, secret.count("-") / n,
        float(bool(parts & FOR) or any(map(telling, near))), float(bool(parts & AGAINST)), float(before.rstrip()[-1:] in ("=", ":") or before.rstrip(" \"'")[-1:] in ("=", ":")), float(before[-1:] in "\"'" if before else False), float("@" in before[-1:] or "@" in after[:1]),
        float(bool(_TEST_PATH.search(path or ""))), float(bool(_LOCK_PATH.search(path or ""))),
    ]


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (candidate, before, after, path, label) made by a fixed generator."""
    r = random.Random(seed)
    hexa, b64, low = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz"
    words = sorted(DICTIONARY)
    text = lambda: " ".join("".join(r.choices(low, k=r.randint(2, 9))) for _ in range(5)) + " "
    make = lambda a, k: "".join(r.choices(a, k=k))
    # passwords that people choose: letters with digits and signs among them
    short = lambda: "".join(r.sample(s := make(low, r.randint(4, 9)) + make(b64[:26], r.randint(0, 3)) + make("0123456789", r.randint(1, 4)) + make("!@#$%&*?", r.randint(0, 3)) + make(low, 3), len(s)))
    paths = ["src/app/settings.py", "config/prod.env", "deploy/values.yaml", "lib/client.js", "src7", "notes.txt", ""]
    out = []
    for _ in range(n):
        name, quote, sign = r.choice(["token", "secret", "api_key", "password", "access_key", "auth", "client_secret", "private_key", "db_password", "DB_PASSWORD", "access_token", "secret_key", "clientSecret", "accessToken"]), r.choice(["", '"', "'"]), r.choice([" = ", "=", ": ", ":"])
        if r.random() < 0.5:
            s = r.choice([make(hexa, r.choice([32, 40, 48, 64])), make(b64, r.randint(20, 64)), "AKIA" + make(b64[:26] + "0123456789", 16), "ghp_" + make(b64[:62], 36), "sk-" + make(b64[:62], 40), make(b64[:62], r.randint(16, 40)), short(), short()])
            out.append((s, text() + name + sign + quote, quote + " " + text(), r.choice(paths), 1))
            continue
        k = r.randrange(10)
        before, after, path = text(), " " + text(), r.choice(paths)
        if k == 0:  # words
            s = r.choice("-_.").join(r.choices(words, k=r.randint(3, 6))) + str(r.randint(0, 99))
        elif k == 1:  # hosts of mail addresses
            s, before = f"mail{r.randint(0, 99)}.{make(low, 7)}.example.com", before + make(low, 6) + "." + make("0123456789", 2) + "@"
        elif k == 2:  # long numbers
            s = make("0123456789", r.randint(16, 19))
        elif k == 3:  # checksums and commits
            s, before = make(hexa, r.choice([32, 40, 64])), before + r.choice(["sha256", "commit", "md5", "checksum", "integrity", "digest"]) + r.choice([" ", ": ", "="])
        elif k == 4:  # identifiers
            h = make(hexa, 32)
            s, before = "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])), before + r.choice(["uuid", "id", "guid"]) + sign
        elif k == 5:  # placeholders
            s, before = r.choice(["your_token_here", "xxxxxxxxxxxxxxxxxxxx", "changeme-password-1", "example-secret-value1", "<password-goes-here>"]), before + name + sign + quote
        elif k == 6:  # paths and file names
            s = "/".join(r.choices(words, k=4)) + f"/{r.choice(words)}{r.randint(0, 999)}.html"
        elif k == 7:  # names in camel case
            s = "".join(w.title() for w in r.choices(words, k=4))
        elif k == 8:  # words and code after a telling name
            w = r.choices(words, k=3)
            s, before = r.choice([f"{w[0]}.{w[1]}", f"{w[0]}_{w[1]}", f"{w[0]}{w[1].title()}", f"{w[0]}.{w[1]}({w[2]})", f"{w[0]}{w[1].title()}()", f"${{{w[0].upper()}_{w[1].upper()}}}", make(low, r.randint(8, 12))]), before + name + sign + quote
        else:  # of tests and lock files
            s, before, path = make(hexa, 40), before + name + sign + quote, r.choice(["tests/fixtures/keys.py", "package-lock.json", "go.sum", "docs/example.md"])
        out.append((s, before, after, path, 0))
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at leaves), threshold, children, and the share of label 1; and
    the words that the coverage feature knows."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    dictionary: frozenset[str] = DICTIONARY

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, threshold, child, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                k = np.flatnonzero(inner)
                node = at[k]
                at[k] = child[node] + (x[k, feature[node]] > threshold[node])
            total += value[at]
        return total / len(self.trees)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 5) -> Forest:
    """Random forest: bootstrap rows, a square root of the features at each node, Gini splits."""
    rng, grown = np.random.default_rng(seed), []
    if not len(x):
        return Forest([])
    tries = max(1, int(math.sqrt(x.shape[1])) + 1)
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        feature, threshold, child, value = [-1], [0.0], [0], [0.0]
        queue = [(0, rows, 0)]
        while queue:
            node, own, level = queue.pop()
            labels = y[own]
            value[node] = float(labels.mean())
            if level >= depth or len(own) < 2 * least or value[node] in (0.0, 1.0):
                continue
            best = (1e-12, -1, 0.0)
            base = value[node] * (1 - value[node])
            for f in rng.choice(x.shape[1], tries, replace=False):
                order = np.argsort(x[own, f], kind="stable")
                v, ones = x[own[order], f], np.cumsum(labels[order])
                n = np.arange(1, len(own))
                p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(own) - n)
                gain = base - (n * p * (1 - p) + (len(own) - n) * q * (1 - q)) / len(own)
                gain[(v[1:] == v[:-1]) | (n < least) | (len(own) - n < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
            if best[1] < 0:
                continue
            right = x[own, best[1]] > best[2]
            feature[node], threshold[node], child[node] = best[1], best[2], len(feature)
            for side in (own[~right], own[right]):
                queue.append((len(feature), side, level + 1))
                feature.append(-1)
                threshold.append(0.0)
                child.append(0)
                value.append(0.0)
        grown.append((np.array(feature), np.array(threshold), np.array(child), np.array(value)))
    return Forest(grown)


def train(findings: list[tuple[str, str, str, str, int]] | None = None, dictionary: frozenset[str] = DICTIONARY) -> Forest:
    """Learns from labelled findings (candidate, before, after, path, label); see labelled_findings.
    A larger dictionary, such as a corpus's frequent words, can be passed."""
    rows = labelled_findings() if findings is None else findings
    x = np.array([features(*r[:4], dictionary) for r in rows], float).reshape(len(rows), -1)
    grown = fit_forest(x, np.array([r[4] for r in rows], float))
    return Forest(grown.trees, dictionary)


def frequent_words(docs: DataFrame, text_col: str = "text", share: float = 0.001, most: int = 20_000) -> frozenset[str]:
    """A dictionary for train(): words of 3 to 12 letters that at least ``share`` of all documents
    hold, the ``most`` frequent at most, which bounds what every task holds.

    All texts are read whole; words are counted once a document.  Null texts have none.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(text_col), r"[^\p{L}]+"), lambda w: F.char_length(w).between(3, 12)))
    held = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    least = docs.count() * share
    return frozenset(r["w"] for r in held.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most).collect())


def judged(text: str | None, path: str | None, forest: Forest) -> list[tuple[int, int, float]]:
    """(start, end, probability) of every candidate of a text."""
    spans = candidates(text)
    if not spans:
        return []
    x = np.array([features(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], path, forest.dictionary) for a, b in spans])
    return [(a, b, float(p)) for (a, b), p in zip(spans, forest.predict(x))]


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: id, start, length, sha256 of the candidate, score, is_secret.

    Null and empty texts have no candidate.  Places count characters.  The candidate itself is not
    returned.  Repeated rows give repeated rows; a null path counts as empty; extra columns are
    ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in slices(batches, "text"):
            at, out = [], []
            for i, (text, path) in enumerate(zip(column(b, "text").to_pylist(), column(b, "path").to_pylist())):
                for s, e, p in judged(text, path, forest):
                    at.append(i)
                    out.append((s, e - s, hashlib.sha256(text[s:e].encode("utf-8", "surrogatepass")).hexdigest(), p))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([column(b, "id").take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], names=["id", "start", "length", "sha256", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")).alias("path"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, sha256 string, score double")
    return found.withColumnRenamed("id", id_col).withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every found secret in ``text_col`` replaced by ``mark``; all columns stay."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts, paths = column(b, text_col).to_pylist(), column(b, path_col).to_pylist() if path_col else None
            for i, t in enumerate(texts):
                for s, e, p in reversed(judged(t, None if paths is None or paths[i] is None else str(paths[i]), forest)):
                    if p >= threshold:
                        texts[i] = texts[i][:s] + mark + texts[i][e:]
            k = b.schema.get_field_index(text_col)
            yield b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))

    return docs.mapInArrow(run, schema)
