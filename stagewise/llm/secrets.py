"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's regex is turned into a Boolean trigram query: an OR of ANDs of the
trigrams that any match must hold, in lower case; of a clause's trigrams the
``CLAUSE_TRIGRAMS`` rarest ones are asked for. One pass of one regex finds the
trigrams of a text that some rule asks for. The index has a posting list
of documents for each of them, in segments of bounded size. Lists of a clause are intersected, and the documents left are verified
with the regex itself; rules without mandatory trigrams (``hex``) scan every
text. Documents are known in the index by a hash of id and text; a collision
only adds a candidate, which the regex then drops.

Spans are code-point offsets, end exclusive, of the leftmost non-overlapping
matches of each rule, found at a cost linear in their number. The three base kinds keep only long enough matches; the
rules after them add spans of their own.

Edge cases: null text is empty and has no spans; repeated rows are scanned each;
ties of start go in the order of the rules; a null doc_id is kept; an empty
table gives no rows; columns other than doc_id and text are ignored, whatever
their names, and redaction keeps them; n_chars, if there is one, follows the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import matches, replaced
from .storage import discard, few_rows, materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches count if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 1


# The three base kinds.
BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
]
#: Kinds that the method adds.
MORE_RULES = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("live_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("package_token", r"npm_[A-Za-z0-9]{36}"),
    Rule("bearer", r"authorization: bearer [A-Za-z0-9._~+/-]{16,}", any_case=True),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@\"']{1,64}:[^\s/:@\"']{1,64}@"),
]
RULES = BASE_RULES + MORE_RULES

SEGMENT_DOCUMENTS = 2000
CLAUSE_TRIGRAMS = 2
_GAP, _MOST = None, 64
#: Characters of English text by frequency; others are rarer.
_FREQUENT = " etaoinshrdlcumwfgypbvk-jxqz"


def _expand(items) -> list[tuple]:
    """Alternatives of a parsed regex: sequences of lower-case characters and gaps."""
    out: list[tuple] = [()]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            new = [(chr(arg).lower(),)]
        elif name == "IN":
            chars = {chr(a).lower() for o, a in arg if str(o) == "LITERAL"}
            new = [(c,) for c in sorted(chars)] if len(chars) <= 8 and all(str(o) == "LITERAL" for o, _ in arg) else [(_GAP,)]
        elif name == "SUBPATTERN":
            new = _expand(arg[-1])
        elif name == "BRANCH":
            new = [x for branch in arg[1] for x in _expand(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            inner = _expand(inner)
            if (low, str(high)) == (0, "1") and all(str(o) == "LITERAL" for o, _ in arg[2]):
                new = [(), *inner]
            elif low == 0 or low > 4:
                new = [(_GAP,)]
            else:
                new = [sum(x, ()) + ((_GAP,) if str(high) != str(low) else ()) for x in product(inner, repeat=low)]
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            new = [()]
        else:
            new = [(_GAP,)]
        out = [a + b for a in out for b in new]
        if len(out) > _MOST:
            return [(_GAP,)]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of mandatory trigrams; None if some match needs no trigram."""
    clauses = set()
    for sequence in _expand(regex_parser.parse(pattern)):
        grams, run = set(), ""
        for c in (*sequence, _GAP):
            if c is _GAP:
                grams |= {run[i : i + 3] for i in range(len(run) - 2)}
                run = ""
            else:
                run += c
        if not grams:
            return None
        clauses.add(frozenset(grams))
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _java(rule: Rule) -> str:
    return ("(?i)" if rule.any_case else "") + rule.pattern


def asked_trigrams(clause: frozenset[str]) -> list[str]:
    """The rarest trigrams of a clause; each of them is mandatory on its own."""
    often = lambda gram: (sum(1 / (1 + _FREQUENT.index(c)) if c in _FREQUENT else 0.02 for c in gram), gram)
    return sorted(sorted(clause, key=often)[:CLAUSE_TRIGRAMS])


def trigram_finder(trigrams: list[str]) -> str:
    """A regex that matches without length wherever one of the trigrams starts; group 1 is the trigram."""
    quoted = lambda text: "".join(f"\\x{ord(c):02x}" for c in text)
    heads = {}
    for gram in trigrams:
        heads.setdefault(gram[0], []).append(quoted(gram[1:]))
    return "(?=(" + "|".join(f"{quoted(head)}(?:{'|'.join(tails)})" for head, tails in heads.items()) + "))"


def index_postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(segment, trigram, documents): the inverted index of the trigrams asked for."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(trigram_finder(trigrams)), F.lit(1)))
    rows = docs.select("key", F.explode(held).alias("trigram"))
    segments = max(1, docs.count() // SEGMENT_DOCUMENTS)
    return rows.withColumn("segment", F.pmod("key", F.lit(segments))).groupBy("segment", "trigram").agg(F.collect_list("key").alias("documents"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, mask): bit r of the mask is set if rule r's query holds for the document. Materialized."""
    spark = docs.sparkSession
    queries = {r: [asked_trigrams(clause) for clause in q] for r, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for clause in q for t in clause})
    clauses = [(t, r, c, len(clause)) for r, q in queries.items() for c, clause in enumerate(q) for t in clause]
    asked = spark.createDataFrame(clauses, "trigram string, rule int, clause int, need int")
    postings = materialize(index_postings(docs, trigrams), "postings")
    lists = postings.join(F.broadcast(asked), "trigram").groupBy("segment", "rule", "clause").agg(F.collect_list("documents").alias("lists"), F.first("need").alias("need")).where(F.size("lists") == F.col("need"))
    both = F.aggregate(F.slice("lists", 2, CLAUSE_TRIGRAMS), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    found = lists.select("rule", F.explode(both).alias("key"))
    out = materialize(found.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask")), "candidates")
    discard(postings)
    return out


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """(start, rule, end) of a rule's matches that are long enough."""
    pattern = F.lit(_java(rule))
    if rule.kind == "hex":
        # a run of hex digits is a match as a whole, so short runs can be passed over
        pattern = F.lit(r"(?<![0-9a-f])[0-9a-f]{%d,}" % rule.least)
    found = F.filter(matches(text, pattern, rule.group), lambda x: x["body"] >= rule.least)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("rule"), x["end"].alias("end")))


def scanned(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc, text, secrets): each row of docs as a struct, its text, and its (start, rule, end) sorted by start and rule."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    joined = rows.join(few_rows(candidates(rows.select("key", "text"), rules)), "key", "left")
    parts, none = [], F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")
    for r, rule in enumerate(rules):
        if trigram_query(rule.pattern) is None:
            gate = F.rlike("text", F.lit("[0-9a-f]{%d}" % rule.least)) if rule.kind == "hex" else F.lit(True)
        else:
            gate = F.coalesce(F.expr(f"mask & {1 << r} <> 0"), F.lit(False))
        parts.append(F.when(gate, _spans(F.col("text"), rule, r)).otherwise(none))
    return joined.select("doc", "text", F.array_sort(F.flatten(F.array(*parts))).alias("secrets"))


def scan_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, secrets) of every row."""
    return scanned(docs.select("doc_id", "text"), rules).select("doc.doc_id", "secrets")


def _listed(spans: Column, rules: list[Rule]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["rule"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Documents with every secret replaced by ``mark``; all columns kept, n_chars adjusted."""
    clean = scanned(docs).withColumn("clean", F.when(F.size("secrets") > 0, replaced(F.col("text"), F.col("secrets"), mark)))
    new = {"text": F.coalesce("clean", "doc.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length("clean").cast(docs.schema["n_chars"].dataType), "doc.n_chars")
    return clean.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_secrets(docs)
    base = F.filter("secrets", lambda x: x["rule"] < len(BASE_RULES))  # rules in order, the base ones first
    count = lambda i: F.size(F.filter("secrets", lambda x: x["rule"] == i)).cast("bigint")
    counts = [count(i).alias(f"n_{rule.kind}") for i, rule in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(_listed(base, RULES), 256).alias("base_sha256"), _listed(F.col("secrets"), RULES).alias("spans"))
