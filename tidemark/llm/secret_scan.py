"""Secret scan: candidate strings, sorted into secrets and false positives by a random forest.

Candidates are: the value after ``=`` or ``:`` and a name of any length with a key word in it
(quoted, or up to white space; any characters, ``SHORTEST_VALUE`` at least); known forms of issued
keys, signed tokens, passwords in addresses (of any length) and key blocks, whatever their letters;
and other unbroken runs of at least ``SHORTEST`` characters of keys and tokens with a digit or
mixed case, but for names that have a value. Where they overlap, the first of these three kinds is
taken. Each is described by its length, its transitions between kinds of characters, its
entropy, how much of it dictionary words cover, whether it stands in a path or address, and by
the words beside it. The forest is Spark's; it is trained on labelled findings (candidates with
a label). ``labelled_findings`` makes the findings used by default, from the forms in which keys
are issued and the things that are mistaken for them; a caller with reviewed findings passes
those instead.

The dictionary is the corpus's own: the ``WORDS`` most frequent words of letters, counted over
all texts, a fixed bound.

Cases: a null text has no candidates; rows that repeat give the same findings each, and rows that
share an id are told apart by a hash of their text; overlapping candidates can't occur; places
count code points; an empty table gives an empty result; other columns are left alone, whatever
their names. A finding tells where it stands and how long it is, never its characters.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, most_frequent

SHORTEST = 12
SHORTEST_VALUE = 4
WORDS = 20_000
TREES = 40
DEPTH = 10
SEED = 11
EXAMPLES = 6_000
#: Characters before a candidate that are looked at for its path and neighbouring words.
BESIDE = 48

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % SHORTEST)
_LETTERS = re.compile(r"[A-Za-z]{3,}")
# fixed values: words that stand beside secrets, and beside what is mistaken for them
KEY_WORDS = tuple("password passwd pwd secret token key api apikey auth bearer credential private access aws client".split())
# a name before = or :, of any length; its beginning is looked for once, so this is linear
_NAME = re.compile(r"(?<![A-Za-z0-9_\-])([A-Za-z0-9_\-]+)[\"']?\s{0,3}[=:]\s{0,3}")
_KEYED = re.compile(r"password|passwd|pwd|passphrase|secret|token|api[_-]?key|apikey|auth|bearer|credential|(?:private|access|secret)[_-]?key", re.I)
_VALUE = re.compile(r"(?:\"([^\"\n]{%d,})\"|'([^'\n]{%d,})'|((?![\"'])\S{%d,}))" % ((SHORTEST_VALUE,) * 3))
_UNBROKEN = re.compile(r"\S*")
_SCHEME = re.compile(r"(?:bearer|basic|token)\s+(?=\S)", re.I)
# fixed values: forms in which keys are issued
_ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{64}|shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32})(?![A-Za-z0-9])")
_SIGNED = re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}")
_ADDRESS = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:([^\s/@]+)@")
_BLOCK = re.compile(r"-----BEGIN ([A-Z ]{0,40})-----[A-Za-z0-9+/=\s\\]{16,}-----END \1-----")
OTHER_WORDS = tuple("sha sha1 sha256 md5 hash commit checksum digest etag uuid guid id version build revision integrity mail href src url file image".split())
N_FEATURES = 25


#: What a text must hold for a pattern to match in it; looking for these is much cheaper.
_NEEDED = {
    _BLOCK: ("-----BEGIN",), _SIGNED: ("eyJ",), _ADDRESS: ("://",),
    _ISSUED: ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "sk_test_", "rk_live_", "rk_test_", "xox", "AIza", "glpat-", "npm_", "hf_", "dop_v1_", "shpat_", "shpca_", "shppa_", "shpss_"),
}
_NAMED = ("passw", "pwd", "passphrase", "secret", "token", "api", "auth", "bearer", "credential", "private", "access")


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each candidate, in order and apart from one another."""
    taken: list[tuple[int, int]] = []
    folded = text.casefold() if "=" in text or ":" in text else ""
    names: list[tuple[int, int]] = []
    upto = 0
    for name in _NAME.finditer(text) if any(word in folded for word in _NAMED) else ():
        # a name within a value is part of that value
        if name.start() < upto or not _KEYED.search(name[1]) or not (m := _VALUE.match(text, name.end())):
            continue
        upto = m.end()
        names.append(name.span(1))
        group = m.lastindex
        start, end = m.span(group)
        if group == 3:  # marks that end a sentence or list aren't part of it
            end = start + len(m[3].rstrip(",;.)]}>\"'"))
        if scheme := _SCHEME.match(text, start):  # Authorization: Bearer ...
            start = scheme.end()
            end = max(end, start + len(_UNBROKEN.match(text, start)[0].rstrip(",;.)]}>\"'")))
        if end - start >= SHORTEST_VALUE:
            taken.append((start, end))
    plain = []
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        digits, lower, upper = (any(test(c) for c in s) for test in (str.isdigit, str.islower, str.isupper))
        if digits or (lower and upper and any(a.islower() and b.isupper() for a, b in zip(s, s[1:], strict=False))):
            plain.append(m.span())
    starts = [a for a, _ in names]  # the value is a candidate, never the name
    plain = [(a, b) for a, b in plain if not (k := bisect.bisect_left(starts, b)) or names[k - 1][1] <= a]
    forms = [m.span(m.lastindex if pattern is _ADDRESS else 0) for pattern in (_BLOCK, _SIGNED, _ISSUED, _ADDRESS) if any(part in text for part in _NEEDED[pattern]) for m in pattern.finditer(text)]
    for more in (_apart(forms), plain):
        taken = _apart(taken)
        starts = [a for a, _ in taken]
        free = [(a, b) for a, b in more if not (k := bisect.bisect_left(starts, b)) or taken[k - 1][1] <= a]
        taken = taken + free
    taken = _apart(taken)
    yield from taken


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, without those that begin within an earlier one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def features(text: str, start: int, end: int, words: frozenset[str]) -> list[float]:
    s = text[start:end]
    kinds = [_kind(c) for c in s]
    moves = [a * 4 + b for a, b in zip(kinds, kinds[1:], strict=False)]
    changed = sum(a // 4 != a % 4 for a in moves) / max(1, len(moves))
    counts = np.unique(list(s), return_counts=True)[1] / len(s)
    runs = _LETTERS.findall(s)
    covered = sum(len(r) for r in runs if r.lower() in words or any(r.lower()[:k] in words and r.lower()[k:] in words for k in range(3, len(r) - 2)))
    before, after = text[max(0, start - BESIDE) : start], text[end : end + 16]
    near = re.findall(r"[a-z0-9]+", (before + " " + after).lower())
    lead = before.rsplit(None, 1)[-1] if before and not before[-1].isspace() else ""
    return [
        float(len(s)),
        changed,
        *[sum(k == kind for k in kinds) / len(s) for kind in range(4)],
        *[sum(m in group for m in moves) / max(1, len(moves)) for group in ((0,), (5,), (10,), (2, 8), (6, 9), (1, 4))],
        float(-(counts * np.log2(counts)).sum()),
        float(len(counts)),
        covered / len(s),
        float(set(s) <= set(string.hexdigits)),
        float("/" in s) + float("://" in lead) + float("/" in lead),
        float("@" in lead or after[:1] == "@"),
        float(before.rstrip(" \"'")[-1:] in ("=", ":")),
        float(any(w in KEY_WORDS for w in near[-6:])),
        float(any(w in OTHER_WORDS for w in near[-6:])),
        float(s.count("-") == 4 and len(s) == 36),
        float(bool(_ISSUED.fullmatch(s) or _SIGNED.fullmatch(s))),
        float(bool(re.search(r"://[^\s/:@]+:$", before)) and after[:1] == "@"),
        float(s.startswith("-----BEGIN")) + float("PRIVATE" in s[:48] and s.startswith("-----BEGIN")),
    ]


def dictionary(docs: DataFrame, text_col: str, words: int = WORDS) -> frozenset[str]:
    """The most frequent words of letters, with the words that keys are named by."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{3,20}"), 0)).alias("word"))
    top = most_frequent(cut(found.groupBy("word").count()), words, "count", "word")
    return frozenset(r[0] for r in top.select("word").collect()) | frozenset(KEY_WORDS)


def labelled_findings(words: frozenset[str], n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, int, int, float]]:
    """(text, start, end, 1.0 for a secret) of made-up findings, half of them secrets."""
    random = np.random.default_rng(seed)
    plain = np.array(sorted(w for w in words if 3 <= len(w) <= 10)[:4000] or ["example", "word", "text"])

    def pick(of: str, low: int, high: int | None = None) -> str:
        size = low if high is None else int(random.integers(low, high + 1))
        return "".join(of[k] for k in random.integers(0, len(of), size))

    def some(low: int, high: int, joint: str = " ") -> str:
        return joint.join(random.choice(plain, random.integers(low, high + 1)))

    alnum, hexes, base64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    digest = lambda: hashlib.sha1(random.bytes(8)).hexdigest()
    name = lambda: str(random.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth_token", "client_secret", "access_key"]))
    named = lambda: str(random.choice(["password", "passwd", "pwd", "DB_PASSWORD", "secret", "api_key"]))
    sign = lambda: str(random.choice(["=", ": ", " = ", ":", "=\"", " = \"", ": \""]))
    block = lambda kind: f"-----BEGIN {kind}-----\n" + "\n".join(pick(base64, 64) for _ in range(random.integers(1, 12))) + f"\n-----END {kind}-----"
    secrets = [
        lambda: ("", "AKIA" + pick(string.ascii_uppercase + "234567" + "0189", 16)),
        lambda: (name() + sign(), pick(hexes, 16, 64)),
        lambda: (name() + sign(), pick(alnum, 16, 48)),
        lambda: (name() + sign(), pick(base64, 40)),
        lambda: ("", "ghp_" + pick(alnum, 36)),
        lambda: ("", "sk_live_" + pick(alnum, 24, 32)),
        lambda: ("Authorization: Bearer ", pick(alnum + "_-", 24, 60)),
        lambda: ("", "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24)),
        lambda: ("", "AIza" + pick(alnum + "_-", 35)),
        lambda: ("", "AKIA" + pick(string.ascii_uppercase, 16)),
        lambda: (named() + sign(), pick(alnum + "!#$%&*+-?@^_~", 8, 20)),
        lambda: (named() + sign(), some(1, 1).capitalize() + pick("0123456789!@#$%&*", 2, 5) + some(1, 1) + pick("!?$#%&", 1, 2)),
        lambda: (named() + sign(), pick(string.ascii_lowercase, 14, 40)),
        lambda: (named() + sign(), pick(string.ascii_uppercase, 14, 40)),
        lambda: (str(random.choice(["password", "passwd", "pwd", "passphrase"])) + "=", some(3, 5, "-")),
        lambda: ("", f"eyJ{pick(alnum, 16, 40)}.eyJ{pick(alnum + '_-', 20, 90)}.{pick(alnum + '_-', 20, 43)}"),
        lambda: (f"{random.choice(['postgres', 'mysql', 'https', 'amqp', 'mongodb'])}://{some(1, 1)}:", pick(alnum + "!$%*-_", 8, 24)),
        lambda: ("", block(str(random.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"])))),
    ]
    others = [
        lambda: (str(random.choice(["commit ", "sha256: ", "md5 = ", "checksum ", "etag: ", "sha1 ", "hash "])), pick(hexes, int(random.choice([32, 40, 64])))),
        lambda: (str(random.choice(["id ", "uuid=", "", "guid: "])), f"{pick(hexes, 8)}-{pick(hexes, 4)}-4{pick(hexes, 3)}-a{pick(hexes, 3)}-{pick(hexes, 12)}"),
        lambda: ("https://" + some(1, 2, ".") + ".com/", some(3, 5, "/") + f"/{random.integers(1, 99)}"),
        lambda: ("", some(2, 4, "-") + f"-{random.integers(1, 999)}"),
        lambda: ("", some(2, 4, "_") + f"_{random.integers(1, 99)}"),
        lambda: ("", "".join(w.capitalize() for w in random.choice(plain, 3))),
        lambda: ("", pick(string.digits, 12, 20)),
        lambda: ("", f"2{pick(string.digits, 3)}-{pick(string.digits, 2)}-{pick(string.digits, 2)}T{pick(string.digits, 6)}"),
        lambda: (name() + sign(), str(random.choice(["your-password-here1", "changeme12345", "xxxxxxxxxxxxxxxx1", "example_token_123", "placeholder_key1", "000000000000000000"]))),
        lambda: (name() + ": ", str(random.choice([w for w in plain if len(w) >= SHORTEST_VALUE] or ["required"]))),
        lambda: (name() + sign(), str(random.choice(["${PASSWORD}", "<your-password>", "os.environ['KEY']", "getenv(KEY)", "required", "********", "changeme", "undefined", "{{ secret }}", "None,null"]))),
        lambda: ("", block(str(random.choice(["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY"])))),
        lambda: (f"https://{some(1, 1)}:", str(random.choice(["password", "${PASSWORD}", "<password>", "********", "changeme"]))),
        lambda: ("version ", f"release-{random.integers(1, 9)}-{random.integers(0, 40)}-{some(1, 1)}"),
        lambda: ("", some(1, 1) + pick(string.digits, 2, 3) + "_" + some(1, 2, "_")),
        lambda: ("", some(1, 1) + str(random.choice(["-", "/", "_"])) + some(2, 3, "-") + pick(string.digits, 1)),
    ]
    out = []
    while len(out) < n:
        label = len(out) % 2
        lead, s = random.choice(secrets if label else others)()
        text = f"{some(2, 6)} {lead}{s}"
        start = len(text) - len(s)
        text += "@" + some(1, 1) + ".example " if "://" in lead and lead.endswith(":") else str(random.choice(["", " ", '" ', ". "]))
        text += some(1, 5)
        found = [c for c in candidates(text) if c[1] > start]
        if found:
            out.append((text, *found[0], float(label)))
        else:
            out.append((text, start, start + len(s), float(label)))
    return out


def train(spark: SparkSession, findings: list[tuple[str, int, int, float]], words: frozenset[str]) -> RandomForestClassificationModel:
    """The forest of labelled findings (text, start, end, label)."""
    rows = [(features(text, start, end, words), label) for text, start, end, label in findings]
    frame = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(frame)


def _described(docs: DataFrame, id_col: str, text_col: str, words: frozenset[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, h, a, b, features(t, a, b, words)) for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t for a, b in candidates(t)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_id", "text_hash", "start", "end", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.col(text_col).alias("_text"))
    return picked.mapInArrow(run, f"_id {kind}, text_hash long, start int, end int, x array<double>")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", findings: list[tuple[str, int, int, float]] | None = None) -> DataFrame:
    """Per candidate: the id of its row, a hash of its text, start, length, score and is_secret."""
    words = dictionary(docs, text_col)
    model = train(docs.sparkSession, findings or labelled_findings(words), words)
    described = cut(_described(docs, id_col, text_col, words)).withColumn("features", array_to_vector("x"))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(described).select(
        F.col("_id").alias(id_col), "text_hash", "start", (F.col("end") - F.col("start")).alias("length"), score.alias("score"), (score >= 0.5).alias("is_secret")
    )


def redact(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each secret of scan's result replaced by a mark."""
    # rows that repeat have the same places, once
    places = found.where("is_secret").groupBy(F.col(id_col).alias("_of"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_set(F.struct("start", "length")), False).alias("_places"))
    # the row is one value, so its columns can't clash
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_own"), F.xxhash64(F.col(text_col)).alias("_key"))
    text = F.col("_doc").getField(text_col)
    # from the last place to the first, so earlier places stay right
    cleaned = F.aggregate("_places", text, lambda t, p: F.concat(F.substring(t, F.lit(1), p["start"]), F.lit(mark), F.substring(t, p["start"] + p["length"] + 1, F.length(t))))
    joined = rows.join(places, F.col("_own").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_hash")), "left")
    return joined.select(*[(F.coalesce(cleaned, text) if c == text_col else F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def secrets_per_document(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The findings that remain once false positives are gone."""
    return scan(docs, id_col=id_col, text_col=text_col, **options).where("is_secret").drop("is_secret")
