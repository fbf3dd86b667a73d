"""Pattern rules over texts: matches with context, and the corpus rating from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matches(docs: DataFrame, rules: list[tuple[str, str, str]], disabled: set[str] = frozenset(), id_col: str = "doc_id", text_col: str = "text", around: int = 40) -> DataFrame:
    """``(id, rule_id, found, context, caret, suggestion)`` for rules (id, pattern, suggestion).

    The rule table is short and fixed; all rules are native expressions of one scan. Matches are found
    by the bare pattern, so the context of one may hold others. It is put together from what
    lies between the matches: at most ``around`` + 1 of them fit into it on either side.
    """
    found, between, each = {}, {}, []
    for k, (rule, pattern, suggestion) in enumerate((r for r in rules if r[0] not in disabled)):
        regex = rf"(?s)(?:{pattern})"
        all_, gaps = f"__all{k}", f"__gaps{k}"
        found[all_], between[gaps] = F.regexp_extract_all(text_col, F.lit(regex), F.lit(0)), F.split(text_col, regex, -1)
        each.append((rule, suggestion, all_, gaps))
    # splitting leaves out the empty piece before an empty match at the start
    whole = {g: F.when(F.size(g) > F.size(a), F.col(g)).otherwise(F.concat(F.array(F.lit("")), g)) for _, _, a, g in each}
    texts = docs.select(id_col, *(c.alias(n) for n, c in (found | between).items())).select(id_col, *found, *(c.alias(n) for n, c in whole.items()))

    def placed(rule, suggestion, all_, gaps):
        def one(x, k):
            low = F.greatest(k - around - 1, F.lit(0))
            before = F.zip_with(F.slice(gaps, low + 1, k - low), F.slice(all_, low + 1, k - low), lambda a, m: F.concat(F.right(a, F.lit(around)), F.right(m, F.lit(around))))
            after = F.zip_with(F.slice(gaps, k + 2, F.lit(around + 1)), F.slice(all_, k + 2, F.lit(around + 1)), lambda a, m: F.concat(F.left(a, F.lit(around)), F.coalesce(F.left(m, F.lit(around)), F.lit(""))))
            before = F.concat(F.array_join(before, ""), F.right(F.element_at(gaps, k + 1), F.lit(around)))
            return F.struct(F.lit(rule).alias("rule_id"), F.lit(suggestion).alias("suggestion"), x.alias("found"), F.right(before, F.lit(around)).alias("before"), F.left(F.array_join(after, ""), F.lit(around)).alias("after"))

        return F.transform(F.coalesce(F.col(all_), F.array().cast("array<string>")), one)

    kind = "array<struct<rule_id:string,suggestion:string,found:string,before:string,after:string>>"
    x = texts.select(id_col, F.explode(F.concat(*(placed(*e) for e in each)) if each else F.array().cast(kind)).alias("x"))
    context = F.replace(F.concat("x.before", "x.found", "x.after"), F.lit("\n"), F.lit(" "))
    caret = F.concat(F.repeat(F.lit(" "), F.length("x.before")), F.repeat(F.lit("^"), F.length("x.found")))
    return x.select(id_col, "x.rule_id", "x.found", context.alias("context"), caret.alias("caret"), "x.suggestion")
