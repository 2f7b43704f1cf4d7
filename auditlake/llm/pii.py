"""Personal data by candidate gradient boosting, in DataFrame functions only.

Strict patterns give the base spans. Loose generators propose more, overlapping
candidates. Each candidate is described by format and context: digits, groups,
marks, letters, its neighbours and the words before it. Boosted trees learn from
all candidates which descriptions belong to real ones (those that a strict
pattern confirms) and give each description a likelihood; a threshold per kind,
set on documents the trees did not see, selects further spans. Base spans stay.

Descriptions are coarse, so the whole corpus shrinks to some thousands of weighted
rows for the trees. The fitted trees become one expression that every candidate
is scored by where it is: none is shuffled, and any number of descriptions will do.

Positions come from the texts between matches: ``split`` and ``regexp_extract_all``
walk a text with the same pattern, so lengths add up to starts and ends in code
points. A text with n matches costs n squared short copies, small up to many
thousands. Patterns are possessive where that changes nothing, so that long runs
neither backtrack nor recurse.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: Strict patterns. A match may begin where the last one ended, else only at the begin of a run.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose generators.
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.:])[0-9]{1,5}(?:[.:,_-][0-9]{1,5}){3,7}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._-]?[0-9]){11,20}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])\+?\(?[0-9]{1,4}\)?(?:[\x20().-]{1,3}[0-9]{2,5}){2,5}(?![0-9])",
}
#: Texts without this cannot match, and are not walked.
NEEDED = {
    "email": "contains({t}, '@') OR contains({t}, '(at)') OR contains({t}, '[at]') OR (contains({t}, ' at ') AND (contains({t}, ' dot ') OR contains({t}, '(dot)') OR contains({t}, '[dot]')))",
    "ip": "{t} RLIKE '[0-9][^0-9A-Za-z][0-9]'",
    "card": "{t} RLIKE '[0-9][^A-Za-z]{{10}}'",
    "phone": "{t} RLIKE '[0-9][^A-Za-z]{{4}}'",
}
HINTS = "mail|write|phone|tel|call|fax|mobile|card|visa|credit|account|ip|host|server|addr|konto|karte|tarjeta|carte|anruf|correo"
#: A kind's further spans are right in this share of its candidates at least, on unseen documents.
PRECISION = 0.9
#: Decimals of a margin.
DIGITS = 3

#: How a disguised email is read before it is described: the same way as one that is not.
_PLAIN_EMAIL = r"regexp_replace(regexp_replace(c.m, ' ?(?:@|\\(at\\)|\\[at\\]| at ) ?', '@'), ' ?(?:\\.|\\(dot\\)|\\[dot\\]| dot ) ?', '.')"

_SPAN = "struct<s:int,e:int,m:string,before:string,after:string>"


def _walk(name: str, keep: str) -> str:
    """SQL: the matches of ``m_name`` between the texts ``g_name``, with positions, filtered by ``keep`` over ``c``."""
    return f"""
      filter(aggregate(
        zip_with(zip_with(m_{name}, g_{name}, (x, y) -> struct(x AS m, y AS before)), slice(g_{name}, 2, greatest(size(m_{name}), 1)),
                 (p, z) -> struct(p.m AS m, p.before AS before, z AS after)),
        struct(0 AS at, cast(array() AS array<{_SPAN}>) AS found),
        (acc, p) -> if(p.m IS NULL, acc, struct(
          acc.at + length(p.before) + length(p.m) AS at,
          concat(acc.found, array(struct(acc.at + length(p.before) AS s, acc.at + length(p.before) + length(p.m) AS e,
                                         p.m AS m, right(p.before, 24) AS before, left(p.after, 1) AS after))) AS found)),
        acc -> acc.found), c -> {keep})"""


_DIGITS = "regexp_replace(c.m, '[^0-9]', '')"
_LUHN = f"""(length({_DIGITS}) BETWEEN 16 AND 19 AND aggregate(
  sequence(1, greatest(1, length({_DIGITS}))), 0,
  (a, i) -> a + if(i % 2 = 1, int(substr(reverse({_DIGITS}), i, 1)),
                   int(substr(reverse({_DIGITS}), i, 1)) * 2 - if(int(substr(reverse({_DIGITS}), i, 1)) > 4, 9, 0))) % 10 = 0)"""
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
VALID = {
    "email": "true",
    "ip": rf"c.m RLIKE '^{_PART}(?:[.]{_PART}){{3}}$'",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}
#: Format and context of a candidate ``c`` in coarse buckets.
_DESCRIPTION = f"""concat_ws('|',
  least(length({_DIGITS}), 20),
  least(size(split(c.m, '[^0-9A-Za-z]+')), 8),
  int(contains(c.m, '(')),
  CASE WHEN c.m NOT RLIKE '[ ._:,-]' THEN 0 WHEN c.m NOT RLIKE '[._:,-]' THEN 1 WHEN c.m NOT RLIKE '[ ._:,]' THEN 2
       WHEN c.m NOT RLIKE '[ _:,-]' THEN 3 ELSE 4 END,
  least(length(regexp_replace(c.m, '[^A-Za-z]', '')) div 4, 8),
  CASE WHEN c.before = '' THEN 0 WHEN right(c.before, 1) RLIKE '[[:space:]]' THEN 1 WHEN right(c.before, 1) RLIKE '[A-Za-z0-9]' THEN 2 ELSE 3 END,
  CASE WHEN c.after = '' THEN 0 WHEN c.after RLIKE '[[:space:]]' THEN 1 WHEN c.after RLIKE '[A-Za-z0-9]' THEN 2 ELSE 3 END,
  int(lower(c.before) RLIKE '(?:{HINTS})'))""".replace("[[:space:]]", r"\\s")


def candidates(docs: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``_base`` and ``_more``: arrays of (kind, s, e), the latter with ``code``, ``real`` and ``veiled``.

    ``_base`` holds the spans of the strict patterns that are valid, in order of
    kind and start; ``_more`` the loose candidates, ``real`` where one overlaps a
    base span of its kind. A disguised email ("bob (at) site (dot) com") is
    described as it reads plainly, and ``veiled``: no strict pattern can confirm it.
    """
    t = "_text"
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(t))
    for kind in KINDS:
        need = F.expr(NEEDED[kind].format(t=t))
        rows = rows.withColumn(f"n_{kind}", need)
    found = {}
    for part, patterns in (("b", BASE), ("l", LOOSE)):
        for kind, pattern in patterns.items():
            name = f"{part}_{kind}"
            gate = F.col(f"n_{kind}")
            # Not matching anything leaves one piece, the whole text; it need not be copied.
            found[f"m_{name}"] = F.when(gate, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
            found[f"g_{name}"] = F.when(gate, F.split(t, pattern, -1)).otherwise(F.array(F.lit("")))
    rows = rows.select(*keep, *(c.alias(n) for n, c in found.items()))
    rows = rows.select(
        *keep,
        *(F.expr(_walk(f"b_{k}", VALID[k])).alias(f"b_{k}") for k in KINDS),
        *(F.expr(_walk(f"l_{k}", "true")).alias(f"l_{k}") for k in KINDS),
    )
    base = [F.expr(f"transform(b_{k}, c -> struct({i} AS kind, c.s AS s, c.e AS e))") for i, k in enumerate(KINDS)]
    read = {k: f"transform(l_{k}, c -> struct(c.s AS s, c.e AS e, c.m AS m, c.before AS before, c.after AS after, false AS veiled))" for k in KINDS}
    read["email"] = f"transform(l_email, c -> struct(c.s AS s, c.e AS e, {_PLAIN_EMAIL} AS m, c.before AS before, c.after AS after, {_PLAIN_EMAIL} != c.m AS veiled))"
    more = [
        F.expr(
            f"transform({read[k]}, c -> struct({i} AS kind, c.s AS s, c.e AS e, concat('{i}|', {_DESCRIPTION}) AS code, "
            f"exists(b_{k}, b -> b.s < c.e AND c.s < b.e) AS real, c.veiled AS veiled))"
        )
        for i, k in enumerate(KINDS)
    ]
    return rows.select(*keep, F.concat(*base).alias("_base"), F.concat(*more).alias("_more"))


#: A leaf's value, or (feature, limit, tree up to the limit, tree beyond it).
Tree = float | tuple


@dataclass
class Selector:
    """Boosted trees as an expression over a description, and per kind the margin from which a candidate is taken."""

    trees: list[tuple[float, Tree]]
    thresholds: dict[str, float]

    def margin(self, x: Column) -> Column:
        """What the trees make of a description as numbers; the larger the likelier."""
        return reduce(lambda a, b: a + b, [F.lit(weight) * _read(tree, x) for weight, tree in self.trees], F.lit(0.0))

    def column(self) -> Column:
        """``_more`` cut down to the selected candidates that overlap no base span of their kind."""
        if not self.thresholds:
            return F.expr("cast(array() AS array<struct<kind:int,s:int,e:int>>)")

        def chosen(c: Column) -> Column:
            margin = F.round(self.margin(c["x"]), DIGITS)
            return reduce(lambda a, b: a | b, [(c["kind"] == KINDS.index(k)) & (margin >= t) for k, t in self.thresholds.items()])

        span = lambda c: [c[part].alias(part) for part in ("kind", "s", "e")]
        open_ = F.filter("_more", lambda c: ~c["real"] & c["kind"].isin([KINDS.index(k) for k in self.thresholds]))
        read = F.transform(open_, lambda c: F.struct(*span(c), _numbers(c["code"]).alias("x")))
        return F.transform(F.filter(read, chosen), lambda c: F.struct(*span(c)))


def _numbers(code: Column) -> Column:
    return F.split(code, "[|]").cast("array<double>")


def _read(tree: Tree, x: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, limit, low, high = tree
    return F.when(x[feature] <= limit, _read(low, x)).otherwise(_read(high, x))


def _grown(node) -> Tree:
    """A fitted tree's node as plain numbers."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    return int(node.split().featureIndex()), float(node.split().threshold()), _grown(node.leftChild()), _grown(node.rightChild())


def fit(found: DataFrame, rounds: int = 12, depth: int = 3, precision: float = PRECISION, seed: int = 3) -> Selector:
    """Fit the trees on the descriptions of all candidates in ``found`` (columns _more and _half).

    Documents with ``_half`` 0 fit, those with 1 calibrate. Disguised candidates
    have no label, so they teach nothing; they are taken like plain ones of the same
    description. Without candidates, or with one class only, nothing is selected.
    """
    counted = (
        found.select("_half", F.explode("_more").alias("c"))
        .filter("NOT c.veiled")
        .groupBy(F.col("c.code").alias("code"))
        .agg(*(F.count_if((F.col("_half") == h) & (F.col("c.real") == r)).alias(f"n{h}{int(r)}") for h in (0, 1) for r in (False, True)))
    )
    counted = materialize(counted)
    size = counted.agg(F.sum("n00"), F.sum("n01")).first()
    if not size[0] or not size[1]:
        return Selector([], {})
    described = counted.withColumn("features", array_to_vector(_numbers(F.col("code"))))
    sides = [described.select("code", "features", F.lit(float(y)).alias("label"), F.col(f"n0{y}").cast("double").alias("weight")) for y in (0, 1)]
    # In a fixed order, so that a run again grows the same trees.
    rows = sides[0].unionByName(sides[1]).filter("weight > 0").repartitionByRange(2, "code", "label").sortWithinPartitions("code", "label")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, weightCol="weight", seed=seed, stepSize=0.3, maxBins=64).fit(rows)
    grown = [(float(w), _grown(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    selector = Selector(grown, {})
    # Rounded margins: however many descriptions there are, some thousands of rows per kind come to the driver.
    scored = counted.groupBy(F.split("code", "[|]")[0].cast("int").alias("kind"), F.round(selector.margin(_numbers(F.col("code"))), DIGITS).alias("p")).agg(
        F.sum("n10").alias("n10"), F.sum("n11").alias("n11")
    )
    selector.thresholds = _select(scored.collect(), precision)
    return selector


def _select(scored: Sequence, precision: float) -> dict[str, float]:
    """Per kind the lowest margin down to which the unseen candidates are real in ``precision`` of cases.

    A description must also be likelier than not, which is a margin above zero:
    where a kind had too few unseen candidates to tell, nothing beyond the base is taken.
    """
    thresholds: dict[str, float] = {}
    for i, kind in enumerate(KINDS):
        real = seen = 0
        for r in sorted((r for r in scored if r["kind"] == i), key=lambda r: -r["p"]):
            real, seen = real + r["n11"], seen + r["n11"] + r["n10"]
            if seen >= 20 and real >= precision * seen and r["p"] >= 0.0:
                thresholds[kind] = r["p"]
    return thresholds


def _halved(docs: DataFrame, doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), F.col(doc_id).cast("string")), F.lit(2)).alias("_half")


def _joined(spans: str) -> Column:
    """kind:start:end by kind as listed, then start."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, c -> concat_ws(':', element_at({names}, c.kind + 1), c.s, c.e)), ',')")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans) per document.

    The counts are of base spans; ``spans`` has the base spans and the selected
    ones. Both are kind:start:end in code points, end exclusive, by kind and start.
    Whole texts are read; null and empty texts hold nothing. Repeated rows give
    repeated results; rows with a null id are searched and keep the null.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"), _halved(docs, doc_id))
    found = materialize(candidates(rows, "_t", ["_id", "_half"]))
    chosen = fit(found)
    both = found.withColumn("_all", F.array_sort(F.concat("_base", chosen.column())))
    counts = [F.expr(f"cast(size(filter(_base, c -> c.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return both.select(F.col("_id").alias(doc_id), *counts, _joined("_base").alias("base_spans"), _joined("_all").alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; overlapping spans become one.

    Columns and their order stay. A null text stays null.
    """
    at = docs.select(F.col(doc_id), F.col(text).alias("_t"), _halved(docs, doc_id))
    chosen = fit(candidates(at, "_t", ["_half"]))
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_t"))
    found = candidates(held, "_t", ["_row"]).select("_row", F.concat("_base", chosen.column()).alias("_all"))
    merged = F.expr("""
      aggregate(array_sort(transform(_all, c -> struct(c.s AS s, c.e AS e, c.kind AS kind))),
        cast(array() AS array<struct<s:int,e:int,kind:int>>),
        (acc, c) -> if(size(acc) > 0 AND c.s < element_at(acc, -1).e,
          concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).s AS s, greatest(element_at(acc, -1).e, c.e) AS e, element_at(acc, -1).kind AS kind))),
          concat(acc, array(c))))""")
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    clean = F.expr(f"""
      if(size(_spans) = 0, _t, concat(
        array_join(transform(_spans, (c, i) -> concat(
          substr(_t, if(i = 0, 0, _spans[i - 1].e) + 1, c.s - if(i = 0, 0, _spans[i - 1].e)), element_at({names}, c.kind + 1))), ''),
        substr(_t, element_at(_spans, -1).e + 1)))""")
    out = found.select("_row", F.col(f"_row.`{text}`").alias("_t"), merged.alias("_spans")).select("_row", clean.alias("_clean"))
    return out.select(*((F.col("_clean") if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
