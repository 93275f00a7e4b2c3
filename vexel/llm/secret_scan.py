"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. The trigrams that its matches must hold make a Boolean query
(:mod:`vexel.llm.trigrams`), of which each conjunction keeps its rarest trigrams: fewer ask less,
so no match is lost. The index holds a posting ``(trigram, document)`` for each of these. The
posting lists that a conjunction names are intersected, and what is found, a document and its
rules, is sent to the texts, which stay where they are; there the rules are verified. Rules
without a mandatory trigram are run on every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.scratch import written
from vexel.llm.trigrams import Query, query_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` must mean the same in Java and RE2; ``value_group`` must have ``min_chars`` characters at least."""

    kind: str
    pattern: str
    min_chars: int = 0
    value_group: int = 0

    @property
    def query(self) -> Query:
        return query_of(self.pattern)


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
BASE = (
    Rule("assign", rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}"),
)
_BASE64 = "[A-Za-z0-9+/=]"
#: What follows the first line of a key file: all up to the END line or, where that is missing, header
#: lines and base64, in lines, escaped lines or joined by blanks.
_KEY_END = r"[^-]*(?:-{1,4}[^-]+){0,20}-----END [A-Z ]*PRIVATE KEY-----"
_LINES = r"[A-Za-z0-9+/=\r\n\\]*"
_JOINED = rf"(?:[\x20\t]+{_BASE64}{{16,}}{_LINES}){{0,50}}"  # RE2 allows no more at a time
_KEY_LINES = rf"(?:[\r\n]+[A-Z][A-Za-z-]+:[^\r\n]*){{0,5}}(?:\\[rn]|[\x20\t\r\n])*{_BASE64}{{16,}}{_LINES}{4 * _JOINED}"
# Published formats of provider tokens and key files.
EXTRA = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_KEY_END}|{_KEY_LINES})?"),
)
RULES = BASE + EXTRA
_SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


#: Trigrams that a conjunction keeps.
RAREST = 3
#: Documents with candidates that are sent to the texts by broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
# Letters by how often English text has them.
_BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"


def asked(rule: Rule) -> Query:
    """The rule's query, each conjunction with its rarest trigrams only, as its letters' ranks multiply."""
    if rule.query is None:
        return None

    def rarity(gram: str) -> float:
        ranks = [_BY_FREQUENCY.find(c) + 1 or len(_BY_FREQUENCY) + 1 for c in gram]
        return ranks[0] * ranks[1] * ranks[2]

    kept = {frozenset(sorted(part, key=lambda g: (-rarity(g), g))[:RAREST]) for part in rule.query}
    return frozenset(x for x in kept if not any(y < x for y in kept))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    """All trigrams that the rules ask for."""
    return sorted({g for r in rules for part in asked(r) or () for g in part})


def _key(doc_id: str, text: str) -> Column:
    """What postings name a document by: its id, or a hash of its text where that is null.

    Rows that share a key share their postings; each is still verified on its own text.
    """
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))


def postings(df: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: rows ``(gram, doc)``, ``gram`` being the place in :func:`vocabulary`.

    A document whose text no conjunction can hold in has no posting in the lists.
    """
    place = {g: k for k, g in enumerate(vocabulary(rules))}

    def held(low: Column) -> Column:
        """Places of the trigrams in a text, those that share a part only if the text holds that."""
        parts = [F.array().cast("array<int>")]
        for shared, grams in _by_part(sorted(place)).items():
            found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(place[g])) for g in grams]))
            parts.append(found if len(grams) == 1 else F.when(F.contains(low, F.lit(shared)), found).otherwise(parts[0]))
        return F.concat(*parts)

    # Bound in a lambda, the lower-cased text is made once, not for each trigram.
    grams = F.transform(F.array(F.lower(text)), held)[0]
    texts = df.where(F.col(text).isNotNull()).select(_key(doc_id, text).alias("doc"), grams.alias("grams"))
    return texts.select("doc", F.explode("grams").alias("gram"))


def _by_part(grams: list[str]) -> dict[str, list[str]]:
    """The trigrams by a part that several share: a sign that is no letter or two letters, most trigrams first."""
    left, found = list(grams), {}
    while left:
        parts: dict[str, list[str]] = {}
        for g in left:
            for p in {c for c in g if not c.isalpha()} or {g[:2], g[1:]}:
                parts.setdefault(p, []).append(g)
        part = max(sorted(parts), key=lambda p: len(parts[p]))
        found[part] = parts[part]
        left = [g for g in left if g not in parts[part]]
    return found


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents in all posting lists of some conjunction of a rule's query: ``doc`` and ``rules``, the rules' places.

    The lists are intersected by counting: of the distinct lists of a conjunction, those that hold
    the document. Partial counts are made where the postings are, so one row for each document
    and task is shuffled.
    """
    known = vocabulary(rules)
    place = {g: k for k, g in enumerate(known)}
    blocks = range(len(known) // 63 + 1)

    def bits(b: int) -> Column:
        return F.bit_or(F.when(F.expr("gram div 63") == b, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") % 63)).otherwise(F.lit(0).cast("long")))

    held = index.groupBy("doc").agg(*[bits(b).alias(f"b{b}") for b in blocks])

    def holds(query: Query) -> Column:
        found = F.lit(False)
        for part in sorted(query, key=sorted):
            every = F.lit(True)
            for b in blocks:
                mask = sum(1 << (place[g] % 63) for g in part if place[g] // 63 == b)
                if mask:
                    every = every & (F.col(f"b{b}").bitwiseAND(F.lit(mask)) == mask)
            found = found | every
        return found

    hit = F.array_compact(F.array(*[F.when(holds(asked(r)), F.lit(k)) for k, r in enumerate(rules) if r.query is not None]))
    return held.select("doc", hit.alias("rules")).where(F.size("rules") > 0)


def _spans(text: str, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches of a rule: what stands between the matches gives their places."""
    found = f"regexp_extract_all({text}, :p, 0)"
    value = f"regexp_extract_all({text}, :p, {rule.value_group})"
    literal = "'" + rule.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    query = f"""transform(filter(aggregate(
        zip_with(zip_with({found}, {value}, (m, v) -> named_struct('m', m, 'v', v)),
            slice(split({text}, :p, -1), 1, size({found})), (x, p) -> named_struct('m', x.m, 'v', x.v, 'p', p)),
        named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,stop:bigint,ok:boolean>>)),
        (s, x) -> named_struct(
            'at', s.at + length(x.p) + length(x.m),
            'spans', concat(s.spans, array(named_struct('start', s.at + length(x.p),
                'stop', s.at + length(x.p) + length(x.m), 'ok', length(x.v) >= {rule.min_chars})))),
        s -> s.spans), z -> z.ok),
        z -> named_struct('start', z.start, 'rank', {rank}, 'stop', z.stop, 'kind', '{rule.kind}'))"""
    return F.expr(query.replace(":p", literal))


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``found``: all spans of all rules as ``(start, rank, stop, kind)`` in code points, end exclusive,
    by start, then by the rules' order.

    Null and empty texts have no spans. Null ids, repeated ids and repeated rows keep a row each.
    A column ``found`` of the input is replaced. An empty input gives an empty result.
    """
    names = [c for c in df.columns if c.lower() != "found"]
    inner = df.select(*[F.col(f"`{c}`").alias(f"_in{k}") for k, c in enumerate(names)])
    i, t = f"_in{names.index(doc_id)}", f"_in{names.index(text)}"
    hits = written(candidates(postings(inner.select(i, t), rules, i, t), rules), "secret_candidates")
    if hits.count() <= BROADCAST_KEYS:
        hits = F.broadcast(hits)
    joined = inner.withColumn("doc", _key(i, t)).join(hits, "doc", "left")
    parts = []
    for k, rule in enumerate(rules):
        may = F.col(t).rlike(rule.pattern)
        if rule.query is not None:
            may = F.array_contains("rules", k) & may
        parts.append(F.when(may, _spans(t, rule, k)))
    none = F.array().cast(_SPAN)
    found = F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts]))
    return joined.select(*[F.col(f"_in{k}").alias(c) for k, c in enumerate(names)], found.alias("found"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base digest and all spans of every document."""
    found = scan(df.select(doc_id, text), RULES, doc_id, text)
    base = F.filter("found", lambda s: s["rank"] < len(BASE))

    def count(rank: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        F.col(doc_id).alias("doc_id"),
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def redact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows with every span, overlapping ones together, replaced by ``mark`` in the text."""
    names = df.columns
    inner = df.toDF(*[f"c{k}" for k in range(len(names))])
    t = f"c{names.index(text)}"
    found = scan(inner, RULES, f"c{names.index(doc_id)}", t)
    clean = F.expr(
        f"""aggregate(found, named_struct('at', 0L, 'out', ''), (s, x) -> named_struct(
            'at', greatest(s.at, x.stop),
            'out', if(x.start < s.at, s.out, concat(s.out, substring({t}, cast(s.at + 1 as int), cast(x.start - s.at as int)), '{mark}'))),
            s -> concat(s.out, substring({t}, cast(s.at + 1 as int))))"""
    )
    changed = F.when(F.size("found") > 0, clean).otherwise(F.col(t))
    return found.select(*[(changed if f"c{k}" == t else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)])
