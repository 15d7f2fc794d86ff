"""Rule-driven regex extraction with line numbers."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpuscope.functions.text import language, let, newlines
from corpuscope.schemas import DEFAULT_SID, PATTERNS
from corpuscope.session import staged

# Rules that are broadcast together.
RULE_BLOCK = 2_000
REFUSED = "not a regular expression of Java"


def matches_with_steps(content: Column, regex: Column) -> Column:
    """array<struct<matched_text, step>> of all non-overlapping matches; the running sum of the
    steps is the number of newlines before a match.

    Lines end at `\\n` only, and `^` matches at every line start; Java does not let it match
    in an empty text, so there it stands for the start of the text.
    The text between matches (`split`) and the matches themselves alternate, so the
    newlines before match i are those of the gaps up to i plus those of earlier matches."""
    regex = F.concat(F.when(content == "", "(?d)").otherwise("(?md)"), regex)
    matches = F.regexp_extract_all(content, regex, F.lit(0))
    gaps = F.split(content, regex, -1)

    def number(found):
        # `split` leaves out the empty gap before an empty match at the very start
        aligned = let(gaps, lambda g: F.when(F.size(g) > F.size(found), g).otherwise(
            F.concat(F.array(F.lit("")), g)))
        return let(aligned, lambda g: F.slice(with_steps(found, g), 1, counted(found, g)))

    def with_steps(found, g):
        return F.transform(found, lambda m, i: F.struct(m.alias("matched_text"), (newlines(F.get(g, i)) + F.when(
            i > 0, newlines(F.get(found, i - 1))).otherwise(0)).alias("step")))

    def counted(found, g):
        # An empty match at the end of the text counts only if the search before it
        # had not already come to the end.
        n = F.size(found)
        empty_at_end = (n > 1) & (F.get(found, n - 1) == "") & (F.get(g, n) == "")
        come_to_end = F.char_length(F.get(g, n - 1)) <= F.when(F.get(found, n - 2) == "", 1).otherwise(0)
        return n - F.when(empty_at_end & come_to_end, 1).otherwise(0)

    return let(matches, lambda found: F.when(F.size(found) > 0, number(found)))


def checked_rules(rules: DataFrame):
    """(usable, refused): rules whose regex Java compiles, and the others with a `reason`.

    The regexes are compiled where the rules lie; none comes to the driver."""
    compiles = F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), F.coalesce("regex", F.lit(""))).isNotNull()
    checked = rules.withColumn("_compiles", compiles)
    return (checked.where("_compiles").drop("_compiles"),
            checked.where("not _compiles").drop("_compiles").withColumn("reason", F.lit(REFUSED)))


def required_literal(regex: str) -> str:
    """The longest run of letters, digits, blanks and underlines that every match of a regex must contain, or ''.

    Only what is certain counts: nothing within groups or classes, no character that a quantifier may
    leave out, and nothing at all where alternatives or flags stand outside of groups."""
    if not regex or "\\Q" in regex or re.search(r"\(\?[a-zA-Z^-]", regex):
        return ""
    runs, run, depth, at = [], "", 0, 0
    while at < len(regex):
        c = regex[at]
        if c == "\\":
            at += 2  # an escape ends a run, whatever it stands for
            c = ""
        elif c == "[":
            at = _after_class(regex, at)
            c = ""
        else:
            at += 1
        if depth == 0 and c == "|":
            return ""
        if depth == 0 and c and (c.isascii() and c.isalnum() or c in "_ "):
            run += c
            continue
        if c in ("?", "*", "{") and depth == 0:
            run = run[:-1]
        runs.append(run)
        run = ""
        depth += (c == "(") - (c == ")")
        if c == "{":  # the numbers of a quantifier
            at = max(at, regex.find("}", at) + 1)
    return max([*runs, run], key=len)


def _after_class(regex: str, at: int) -> int:
    """The place after a class that begins at `at`; classes may hold classes."""
    depth = 0
    while at < len(regex):
        if regex[at] == "\\":
            at += 1
        elif regex[at] == "[":
            depth += 1
            at += 2 if regex[at + 1:at + 2] == "^" else 1
            if regex[at:at + 1] == "]":  # the first bracket of a class stands for itself
                at += 1
            continue
        elif regex[at] == "]":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return at


@F.pandas_udf(T.StringType())
def _literals(regex: pd.Series) -> pd.Series:
    return regex.map(required_literal)


def applicable_rules(files: DataFrame, rules: DataFrame, block: int = RULE_BLOCK) -> DataFrame:
    """Files joined with the rules of their language and the rules for any language whose literal they hold.

    A file looks up two keys, its language and '' (where there are rules for any), so the "equal or
    any" condition is an equi-join. Rules are counted first and broadcast in parts of about `block`, so that
    no contents are shuffled however many rules there are. The literal that each match of a rule must hold is
    looked for first: a plain search costs little beside a regex."""
    known = rules.where((F.col("regex") != "") & F.col("regex").isNotNull()).select(
        F.coalesce("language", F.lit("")).alias("rule_language"),
        "pattern_name", "action", "log_key", "regex", F.xxhash64(*rules.columns).alias("rule_no"), _literals("regex").alias("literal"))
    known = staged(known, "rules")
    counted = known.agg(F.count("*").alias("n"), F.count_if(F.col("rule_language") == "").alias("for_any")).first()
    keys = F.array("language", F.lit("")) if counted["for_any"] else F.array("language")
    asking = files.withColumn("rule_language", F.explode(keys))
    parts = max(1, -(-counted["n"] // block))
    found = None
    for part in range(parts):
        some = known if parts == 1 else known.where(F.pmod("rule_no", F.lit(parts)) == part)
        met = asking.join(F.broadcast(some), "rule_language").where((F.col("literal") == "") | F.contains("content", F.col("literal"))).drop("literal")
        found = met if found is None else found.unionAll(met)
    return found


def extract_patterns(files: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """All matches of all applicable rules, one row each.

    Regexes are Java's in multi-line mode with `\\n` as the only line end; a rule that Java refuses
    has no match (`checked_rules` names it). Contents are not shuffled; line numbers are a running
    sum over the match rows of a file and rule, which spills where they are very many."""
    usable, _ = checked_rules(rules)
    with_language = files.select(
        F.coalesce("sid", F.lit(DEFAULT_SID)).alias("sid"), "file_path", "content",
        language(F.col("file_path")).alias("language"))
    # The expression stays inside the explode: on a column of its own, Spark would derive a
    # filter from the explode and match every text twice.
    found = applicable_rules(with_language, usable).select(
        "sid", "file_path", "pattern_name", "log_key", "action", "rule_no",
        F.posexplode(matches_with_steps(F.col("content"), F.col("regex"))).alias("match_no", "m"))
    so_far = Window.partitionBy("file_path", "sid", "rule_no").orderBy("match_no").rowsBetween(Window.unboundedPreceding, 0)
    return found.select("*", F.col("m.matched_text").alias("matched_text"),
                        (F.sum("m.step").over(so_far) + 1).cast("int").alias("line_number"),
                        F.lit(now).cast("long").alias("timestamp")).select(*PATTERNS.names)
