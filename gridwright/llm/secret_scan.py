"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are values that stand after a credential word and ``=`` or ``:``, runs
of key characters that hold a digit, and private key blocks. A forest, trained
from findings labelled by evidence or by a person, scores each from its length, its character transitions
(between small vowels and consonants, capitals, digits and other signs), the
share that dictionary words cover, the words of its path and the words next to it.

Training reads a sample of documents, ``max_documents`` at most in expectation
and chosen by hash; the words of the dictionary are counted over all of them (those
in one of a thousand documents or more enter). Scanning reads each whole text once
in a single pass without a shuffle; the forest and the dictionary that go along
have a largest size that doesn't depend on how many documents there are.

Defined cases: a null text is an empty one and has no candidates; repeated rows
give their findings each; extra columns are ignored unless named in ``keep``;
without labelled findings every candidate stays (score 0.5), with one label only
every score is that label; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import string
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.frames import PIECE_ROWS, column, map_columns, released, text_of
from gridwright.session import checkpoint, scratch_path

#: Words that announce a credential.
CREDENTIAL_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key",
                    "accesskey", "auth", "bearer", "credential", "private_key")
#: Words that announce an example.
EXAMPLE_WORDS = ("example", "sample", "test", "dummy", "fake", "placeholder", "your", "changeme", "xxx")
#: Words that stand beside those in a value that is to be filled in.
FILLERS = ("here", "value", "insert", "replace", "enter", "user", "name", "key", "api", "the", "this", "my")
#: Published key formats.
FORMATS = (
    "(?:AKIA|ASIA)[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{36,}", "github_pat_[A-Za-z0-9_]{22,}", r"glpat-[A-Za-z0-9_\-]{20,}", "[sr]k_live_[A-Za-z0-9]{16,}",
    "whsec_[A-Za-z0-9+/]{24,}", r"xox[abeoprs]-[A-Za-z0-9\-]{10,}", r"AIza[A-Za-z0-9_\-]{35}", r"sk-(?:[a-z]+-)?[A-Za-z0-9_]{20,}", "npm_[A-Za-z0-9]{36}",
    "hf_[A-Za-z0-9]{30,}", "dop_v1_[0-9a-f]{64}", "shpat_[0-9a-f]{32}", r"eyJ[A-Za-z0-9_\-]{16,}")
#: A value in so many different surroundings is no secret, unless its format or a credential word says so.
MANY_PLACES = 5
#: Words of a path by what they tell.
PATH_WORDS = (("test", "spec", "fixture", "mock"), ("doc", "docs", "readme", "example", "sample", "md", "rst"),
              ("conf", "config", "env", "settings", "yaml", "yml", "ini", "toml", "properties", "json"),
              ("py", "js", "java", "go", "rb", "c", "cpp", "ts", "rs", "sh"))

_KEY = "|".join(CREDENTIAL_WORDS)
CANDIDATE = re.compile(
    # without an end line, the block ends with its last line of headers or base64
    r"(?P<block>-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN ).)*?-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s*\n[ \t]*(?:[A-Za-z-]{4,20}: [^\n]*|[A-Za-z0-9+/]{16,}={0,2}(?![^\s\\\"']))|[ \t]*\\n[A-Za-z0-9+/]{16,}={0,2})*"
    r"(?:\s*\n[A-Za-z0-9+/]{1,15}={1,2}(?!\S))?))"
    r"|(?i:(?<![a-z0-9])(?:" + _KEY + r"))[\"']?[ \t]{0,8}[:=][ \t]{0,8}[\"']?(?P<value>[^\s\"',;]{6,})"
    r"|(?<![A-Za-z0-9+/_=\-])(?=[A-Za-z+/_\-]*[0-9])(?P<run>[A-Za-z0-9+/_\-]{8,}={0,2})", re.DOTALL)
_PARTS = re.compile(r"[^\W\d_]+")
#: A word of the dictionary: letters of any alphabet, nothing else that belongs to a word around them.
_WORD = re.compile(r"(?<!\w)[^\W\d_]{4,}(?!\w)")
_VOWELS = frozenset("aeiouy")
#: Words that a task counts before it hands the counts on.
WORDS_HELD = 100_000
#: How much text on either side counts as neighbouring words.
NEAR = 40


def _kind(c: str) -> int:
    if "a" <= c <= "z":
        return 0 if c in _VOWELS else 1
    return 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4


@lru_cache(4)
def _longest(dictionary: frozenset[str]) -> int:
    return max(map(len, dictionary), default=0)


def _coverage(value: str, dictionary: frozenset[str]) -> float:
    """Share of the characters that the longest dictionary words from each place cover."""
    covered, longest = 0, _longest(dictionary)
    for run in _PARTS.findall(value.lower()):
        at = 0
        while at < len(run) - 3:
            size = next((n for n in range(min(longest, len(run) - at), 3, -1) if run[at: at + n] in dictionary), 0)
            covered += size
            at += size or 1
    return covered / len(value)


def features(value: str, before: str, after: str, path: str, dictionary: frozenset[str]) -> list[float]:
    kinds = [_kind(c) for c in value]
    moves = Counter(zip(kinds, kinds[1:]))
    counts = Counter(value)
    steps = max(1, len(value) - 1)
    left, right = before.lower(), after.lower()
    words = set(re.findall(r"[a-z]+", path.lower()))
    return [
        float(len(value)), math.log(len(value)),
        -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values()), len(counts) / len(value),
        *(kinds.count(k) / len(value) for k in range(5)),
        *(moves[a, b] / steps for a in range(5) for b in range(5)),
        sum(n for (a, b), n in moves.items() if a != b) / steps,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        _coverage(value, dictionary),
        float(any(w in left for w in CREDENTIAL_WORDS)),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(before[-1:] in ("'", '"')), float(before[-1:] in (" ", "\n", "")),
        float(any(w in left or w in right or w in value.lower() for w in EXAMPLE_WORDS)),
        float(any(w in right for w in CREDENTIAL_WORDS)),
        *(float(bool(words & set(group))) for group in PATH_WORDS), float(path.count("/")), float(bool(path)),
    ]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """The spans of the candidate values in a text, in code points."""
    for found in CANDIDATE.finditer(text):
        yield found.span(found.lastgroup)


@dataclass(frozen=True)
class SecretModel:
    """``trees`` hold per node: feature (-1 at a leaf), threshold, left, right, vote."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    dictionary: frozenset[str] = frozenset()
    constant: float = 0.5

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The share of trees that vote for a secret."""
        if not self.trees:
            return np.full(len(rows), self.constant)
        votes = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, threshold, left, right, vote in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while (feature[at] >= 0).any():
                inner = feature[at] >= 0
                down = np.where(rows[every, feature[at]] <= threshold[at], left[at], right[at])
                at = np.where(inner, down, at)
            votes += vote[at]
        return votes / len(self.trees)


def _trees(fitted: RandomForestClassificationModel, spark: SparkSession) -> list[tuple[np.ndarray, ...]]:
    """The trees of a fitted forest from the table of nodes that the model is saved as."""
    path = scratch_path(spark, "forest")
    fitted.save(path)
    nodes: dict[int, dict[int, Row]] = {}
    for r in spark.read.parquet(os.path.join(path, "data")).select("treeID", "nodeData.*").collect():  # the model's own size
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for _, tree in sorted(nodes.items()):
        rows = [tree[i] for i in range(len(tree))]
        inner = [r["leftChild"] >= 0 for r in rows]
        out.append((
            np.array([r["split"]["featureIndex"] if x else -1 for r, x in zip(rows, inner)], dtype=np.int64),
            np.array([r["split"]["leftCategoriesOrThreshold"][0] if x else 0.0 for r, x in zip(rows, inner)]),
            np.array([r["leftChild"] if x else 0 for r, x in zip(rows, inner)], dtype=np.int64),
            np.array([r["rightChild"] if x else 0 for r, x in zip(rows, inner)], dtype=np.int64),
            np.array([0.0 if x else r["prediction"] for r, x in zip(rows, inner)])))
    return out


def _near(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - NEAR): start], text[end: end + NEAR]


def by_evidence(found: DataFrame) -> DataFrame:
    """The findings with a ``label`` where there is evidence: 1 a secret, 0 a false positive, null unknown.

    Secrets are values of published key formats, and values of credential words
    that hold a digit or have the make of a phrase (several parts, capitals inside,
    signs). False positives are examples (nothing is left of the value without
    example words, or it is marked as one), blanks to fill in, code, a plain word
    after credential words in many places; of bare runs, numbers, words and numbers
    in a row, and what stands in many different places. Other bare runs stay unlabelled.
    """
    value, low = F.col("value"), F.lower("value")
    assigned = F.col("before").rlike(r"(?i)(" + _KEY + r")[\"']?\s*[:=]\s*[\"']?$")
    known = value.rlike("^(?:" + "|".join(FORMATS) + r")={0,2}$") | value.startswith("-----BEGIN ")
    rest = F.regexp_replace(low, "|".join((*EXAMPLE_WORDS, *CREDENTIAL_WORDS, *FILLERS)), "")
    example = value.rlike("EXAMPLE(?:KEY)?$") | low.rlike("|".join(EXAMPLE_WORDS)) & (F.length(F.regexp_replace(rest, "[^a-z]", "")) <= 2)
    blank = (value.rlike(r"^[<$%{\[(]|[(\[{]|^(.)\1+$|^\*{3}|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$")
             | low.isin("null", "none", "true", "false", "undefined", "required", "optional", "string", "redacted", "hidden"))
    phrase = (F.length("value") >= 8) & value.rlike(r"[A-Za-z]{2}[^A-Za-z\s]+[A-Za-z]{2}|[a-z][A-Z]|[!@#$%^&*+]")
    plain = value.rlike(r"^[0-9+/_\-]+=*$|^(?:[A-Z]?[a-z]{2,}|[0-9]+)(?:[-_/+](?:[A-Z]?[a-z]{2,}|[0-9]+))*$|^[A-Za-z]{3,15}[0-9]{1,4}$")
    label = (
        F.when(example & ~value.startswith("-----BEGIN "), 0).when(known, 1)
        .when(assigned, F.when(blank, 0).when(value.rlike("[0-9]") | phrase, 1).when(F.col("many"), 0))
        .when(plain | F.col("many"), 0))
    found = found.withColumn("mark", F.xxhash64("value"))
    many = found.groupBy("mark").agg(F.count_distinct(F.xxhash64("before", "after")).alias("places")).filter(F.col("places") >= MANY_PLACES)
    found = found.join(many.select("mark", F.lit(True).alias("many")), "mark", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    return found.withColumn("label", label).drop("mark", "many")


def made_up(dictionary: frozenset[str], each: int = 12, seed: int = 5) -> list[tuple[list[float], int]]:
    """Features and labels of invented findings, so that formats which the sample lacks are known too."""
    rng = random.Random(seed)
    words = sorted(dictionary) or ["word"]
    paths = ("", "web", "src/app.py", "docs/readme.md", "config/settings.yml", "tests/test_app.py")

    def of(signs: str, n: int) -> str:
        return "".join(rng.choice(signs) for _ in range(n))

    def prose(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    low, digits = string.ascii_lowercase, string.digits
    hexes, letters = digits + "abcdef", string.ascii_letters + digits
    bare = [
        lambda: rng.choice(("AKIA", "ASIA")) + of(string.ascii_uppercase + digits, 16), lambda: f"gh{rng.choice('pousr')}_{of(letters, 36)}",
        lambda: f"github_pat_{of(letters, 22)}_{of(letters, 59)}", lambda: f"glpat-{of(letters, 20)}", lambda: f"{rng.choice('sr')}k_live_{of(letters, 24)}",
        lambda: f"whsec_{of(letters, 32)}", lambda: f"xox{rng.choice('abprs')}-{of(digits, 11)}-{of(digits, 12)}-{of(letters, 24)}", lambda: f"AIza{of(letters + '_-', 35)}",
        lambda: f"sk-{of(letters, 48)}", lambda: f"npm_{of(letters, 36)}", lambda: f"hf_{of(letters, 34)}", lambda: f"dop_v1_{of(hexes, 64)}", lambda: f"shpat_{of(hexes, 32)}",
        lambda: f"eyJ{of(letters, 40)}", lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{of(letters + '+/', 64)}\n{of(letters + '+/', 64)}\n-----END RSA PRIVATE KEY-----"]
    assigned = [
        lambda: of(hexes, rng.choice((16, 18, 32, 40, 64))), lambda: of(letters + "+/", rng.choice((20, 40))), lambda: of(letters + "!@#$%", 12),
        lambda: "-".join(of(low, rng.randint(4, 8)) for _ in range(rng.randint(2, 4))), lambda: "-".join(prose(rng.randint(2, 4)).split()), lambda: prose(1) + of(digits, 4)]
    numbers = [
        lambda: f"20{of(digits, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"555-{of(digits, 4)}", lambda: of(digits, rng.choice((8, 10, 12, 16))),
        lambda: f"20{of(digits, 2)}-{of(digits, 4)}-{of(digits, 4)}", lambda: f"{'-'.join(prose(2).split())}-{of(digits, 2)}", lambda: f"{prose(1)}{of(digits, 2)}"]
    examples = [
        lambda: f"{rng.choice(('changeme', 'example', 'sample', 'dummy', 'test', 'placeholder', 'fake'))}{of(digits, rng.randint(0, 3))}", lambda: "your-api-key-here",
        lambda: "your_password", lambda: "xxxxxxxxxxxx", lambda: "example-secret-1", lambda: "test_token_123", lambda: "<password>", lambda: "${SECRET_KEY}", lambda: "os.environ["]

    def place(value: str, label: int, credential: bool) -> tuple[list[float], int]:
        sign, quote = rng.choice((": ", "=", " = ")), rng.choice(("", "'", '"'))
        if credential:
            name = rng.choice(CREDENTIAL_WORDS)
            before = prose(3) + " " + (name.upper() if rng.random() < 0.3 else name) + sign + quote
        else:
            before = prose(5) + rng.choice((" ", " ", "\n", " '", ' "', " key id: "))
            quote = before[-1:] if before[-1:] in "'\"" else ""
        return features(value, before[-NEAR:], (quote + " " + prose(5))[:NEAR], rng.choice(paths), dictionary), label

    return [place(make(), label, credential) for makers, label, credentials in (
        (bare, 1, (False, False, True)), (assigned, 1, (True,) * 3), (numbers, 0, (False,) * 3), (examples, 0, (True,) * 3))
        for make in makers for credential in credentials for _ in range(each)]


def findings(docs: DataFrame, dictionary: frozenset[str] = frozenset(), id_column: str = "doc_id", text_column: str = "text",
             path_column: str | None = "source") -> DataFrame:
    """All candidates with the words around them and their features: what a person labels for training."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, start, end, text[start:end], *_near(text, start, end), path)
                for doc, text, path in zip(*(c.to_pylist() for c in batch.columns)) for start, end in candidates(text)
            ]
            if rows:
                cells = [list(x) for x in zip(*rows)]
                types = [batch.schema.field(0).type, pa.int64(), pa.int64(), *[pa.string()] * 4]
                arrays = [pa.array(x, type=t) for x, t in zip(cells, types)]
                vectors = pa.array([features(*r[3:], dictionary) for r in rows], type=pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*arrays, vectors], names)

    rows = _rows(docs, id_column, text_column, path_column)
    names = ["doc_id", "start", "end", "value", "before", "after", "path", "features"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(scan), (
        f"doc_id {kind}, start long, end long, value string, before string, after string, path string, features array<double>"))


def _rows(docs: DataFrame, id_column: str, text_column: str, path_column: str | None) -> DataFrame:
    path = F.lit("") if path_column is None else text_of(path_column)
    return docs.select(column(id_column).alias("doc_id"), text_of(text_column).alias("text"), path.alias("path"))


def dictionary_of(docs: DataFrame, share: float = 0.001, text_column: str = "text") -> frozenset[str]:
    """The words of four or more letters of any alphabet, in small letters, that stand in at least ``share`` of all documents.

    There are at most (distinct words of a document on average) / ``share`` of them, however many documents there are.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.string()), pa.array(list(seen.values()), type=pa.int64())], ["word", "n"])

        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(_WORD.findall(text.lower())))
                if len(seen) > WORDS_HELD:
                    yield table()
                    seen.clear()
        yield table()

    found = docs.select(text_of(text_column).alias("text")).mapInArrow(released(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r["word"] for r in found.filter(F.col("n") >= share * docs.count()).collect())


def sample_of(docs: DataFrame, max_documents: int = 20_000, id_column: str = "doc_id") -> DataFrame:
    """The documents with the lowest hashes of their ids, about ``max_documents`` where there are more."""
    count = docs.count()
    if count <= max_documents:
        return docs
    return docs.filter(F.xxhash64(column(id_column)) <= F.lit(int(-(2**63) + max_documents / count * (2**64 - 1))))


def fit(labelled: DataFrame, dictionary: frozenset[str], trees: int = 20, depth: int = 6, seed: int = 5) -> SecretModel:
    """A forest from rows with ``features`` and ``label`` (1: a secret, 0: a false positive)."""
    rows = checkpoint(labelled.filter("label IN (0, 1)").select(
        F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features")))
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return SecretModel(dictionary=dictionary, constant=float(next(iter(seen), 0.5)))
    fitted = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)
    return SecretModel(_trees(fitted, labelled.sparkSession), dictionary)


def _scored(model: SecretModel, texts: Sequence[str], paths: Sequence[str]) -> list[list[tuple[int, int, float]]]:
    """Per text its candidates with their scores."""
    spans = [list(candidates(t)) for t in texts]
    rows = [
        features(text[a:b], *_near(text, a, b), path, model.dictionary)
        for text, path, found in zip(texts, paths, spans) for a, b in found
    ]
    scores = iter(model.score(np.array(rows)).tolist() if rows else [])
    return [[(a, b, next(scores)) for a, b in found] for found in spans]


def scan(docs: DataFrame, model: SecretModel, id_column: str = "doc_id", text_column: str = "text",
         path_column: str | None = "source") -> DataFrame:
    """Every candidate: ``doc_id``, its span in code points, the SHA-256 of its value, ``score`` and ``secret`` (0 or 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees and dictionary have a fixed largest size

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PIECE_ROWS) for b in batches for at in range(0, b.num_rows, PIECE_ROWS)):
            docs_, texts, paths = (c.to_pylist() for c in batch.columns)
            rows = [
                (doc, a, b, hashlib.sha256(text[a:b].encode("utf-8", "replace")).hexdigest(), score, int(score >= 0.5))
                for doc, text, found in zip(docs_, texts, _scored(shared.value, texts, paths)) for a, b, score in found
            ]
            if rows:
                types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), type=t) for x, t in zip(zip(*rows), types)], ["doc_id", "start", "end", "value_sha256", "score", "secret"])

    rows = _rows(docs, id_column, text_column, path_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(scanned), f"doc_id {kind}, start long, end long, value_sha256 string, score double, secret int")


def redact(docs: DataFrame, model: SecretModel, text_column: str = "text", path_column: str | None = "source",
           mark: str = "[SECRET]") -> DataFrame:
    """The rows as they are, with every secret in the text column replaced by ``mark``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def cleaned(columns: list[pa.Array]) -> list[pa.Array]:
        *columns, paths = columns
        texts, out = columns[place].to_pylist(), []
        for text, found in zip(texts, _scored(shared.value, [t or "" for t in texts], paths.to_pylist())):
            for a, b, score in reversed(found):
                if score >= 0.5:
                    text = text[:a] + mark + text[b:]
            out.append(text)
        columns[place] = pa.array(out, type=columns[place].type)
        return columns

    path = F.lit("") if path_column is None else text_of(path_column)
    return map_columns(docs.select(*[column(c) for c in docs.columns], path), cleaned, docs.schema)
