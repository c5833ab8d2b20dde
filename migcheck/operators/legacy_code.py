"""Summaries of legacy programs and scripts by line patterns, as DataFrame code over (name, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# First word of a statement -> kind of rule.
VERBS = {
    "IF": "validation", "EVALUATE": "validation", "COMPUTE": "calculation", "ADD": "calculation", "SUBTRACT": "calculation",
    "MULTIPLY": "calculation", "DIVIDE": "calculation", "MOVE": "mapping", "PERFORM": "workflow", "CALL": "workflow",
}

# Words of a condition that raise its severity.
HIGH, MEDIUM = "INVALID|ERROR|REJECT", "NOT|NUMERIC|ALPHABETIC|ZERO|SPACE"


def program_lines(programs: DataFrame) -> DataFrame:
    """(program, line, text): upper-case statements without sequence numbers, identification columns and comments."""
    lines = programs.select("program", F.posexplode(F.split("source", "\r?\n")).alias("at", "raw"))
    body = F.when(F.length("raw") > 6, F.substring("raw", 7, 66)).otherwise(F.col("raw"))
    return lines.where(F.substring("raw", 7, 1) != "*").select(
        "program", (F.col("at") + 1).alias("line"), F.upper(F.regexp_replace(body, r"\s+$", "")).alias("text")
    )


def severity(text: Column) -> Column:
    return F.when(text.rlike(HIGH), "HIGH").when(text.rlike(MEDIUM), "MEDIUM").otherwise("INFO")


def cobol_rules(programs: DataFrame) -> DataFrame:
    """program, line, paragraph, verb, rule_type, severity of the statements of each procedure division.

    A paragraph's name carries on to the lines below it; one program's lines meet in one task.
    """
    lines = program_lines(programs)
    header = F.regexp_extract("text", r"^ ?([A-Z0-9][A-Z0-9-]*)\.$", 1)
    inside = F.max(F.contains("text", F.lit("PROCEDURE DIVISION")).cast("int"))
    before = W.partitionBy("program").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    placed = lines.withColumns(
        {"paragraph": F.last(F.when(header != "", header), ignorenulls=True).over(before), "inside": inside.over(before), "verb": F.regexp_extract(F.trim("text"), r"^([A-Z]+)\b", 1)}
    )
    kinds = F.create_map(*(F.lit(x) for pair in VERBS.items() for x in pair))
    found = placed.where((F.col("inside") == 1) & F.col("verb").isin(*VERBS))
    grave = F.when(F.col("verb") == "IF", severity(F.col("text"))).otherwise("INFO")
    return found.select("program", "line", F.coalesce("paragraph", F.lit("")).alias("paragraph"), "verb", kinds[F.col("verb")].alias("rule_type"), grave.alias("severity"))


NAME = "[A-Z][A-Z0-9-]*"


def program_layouts(programs: DataFrame, least: int = 2) -> DataFrame:
    """program, record, n_fields, fields of the level-01 records with at least ``least`` fields that have a picture.

    Fields are listed in their order; FILLER counts as one.  A record ends at the next level 01.
    """
    item = r"^\s*([0-9]{2})\s+(" + NAME + ")"
    lines = program_lines(programs).where(F.col("text").rlike(item)).withColumns({"level": F.regexp_extract("text", item, 1), "name": F.regexp_extract("text", item, 2)})
    before = W.partitionBy("program").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    placed = lines.withColumn("record", F.last(F.when(F.col("level") == "01", F.struct("line", "name")), ignorenulls=True).over(before))
    inner = placed.where(F.col("record").isNotNull() & (F.col("level") != "01") & F.col("text").rlike(r"\bPIC(TURE)?\b"))
    fields = F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: x["name"])  # lines of one record
    found = inner.groupBy("program", "record").agg(F.count("*").alias("n_fields"), F.array_join(fields, ",").alias("fields")).where(F.col("n_fields") >= least)
    return found.select("program", F.col("record.name").alias("record"), "n_fields", "fields")


def field_uses(programs: DataFrame) -> DataFrame:
    """(program, field, mode): fields that MOVE, ADD, COMPUTE and IF statements of a procedure division read (r) or write (w)."""
    lines = program_lines(programs)
    start = F.min(F.when(F.contains("text", F.lit("PROCEDURE DIVISION")), F.col("line"))).over(W.partitionBy("program"))
    text = F.regexp_replace("text", "'[^']*'", "0")
    # Statement -> the fields it reads and those it writes, by the words around them.
    forms = {
        f"MOVE +({NAME}) +TO ": "r", f"MOVE +[^ ]+ +TO +({NAME})": "w", f"ADD +({NAME}) +TO ": "r", f"ADD +[^ ]+ +TO +({NAME})": "w",
        f"COMPUTE +({NAME}) *=": "w", f"(?:=|[-+*/]) +({NAME})": "r", f"IF +({NAME})": "r",
    }

    def used(form: str, mode: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(1)), lambda f: F.struct(f.alias("field"), F.lit(mode).alias("mode")))

    found = [used(form, mode) for form, mode in forms.items()]
    inside = lines.withColumn("start", start).where(F.col("line") > F.col("start"))
    return inside.select("program", F.explode(F.concat(*found)).alias("x")).select("program", "x.field", "x.mode").distinct()


def sql_tables(scripts: DataFrame) -> DataFrame:
    """(name, table, use): tables that a script reads or writes, by the words before them; comments are taken out first."""
    plain = F.lower(F.regexp_replace(F.regexp_replace("script", r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " "))
    uses = {"read": r"\b(?:from|join)\s+([a-z_][\w.]*)", "write": r"\b(?:insert\s+into|update|merge\s+into|delete\s+from|truncate\s+table)\s+([a-z_][\w.]*)"}
    plain = F.regexp_replace(plain, r"\bdelete\s+from\b", "delete_from ")
    uses["write"] = uses["write"].replace(r"delete\s+from", "delete_from ")

    def found(use: str) -> Column:
        return F.transform(F.regexp_extract_all(plain, F.lit(uses[use]), F.lit(1)), lambda t: F.struct(t.alias("table"), F.lit(use).alias("use")))

    arrays = [found(use) for use in uses]
    return scripts.select("name", F.explode(F.array_distinct(F.concat(*arrays))).alias("x")).select("name", "x.table", "x.use")


# Words that mark a comment for review.
REVIEW = "TODO|Review|REVIEW|WARNING|FIXME"


def review_notes(scripts: DataFrame) -> DataFrame:
    """(name, kind, note): comment lines of scripts that ask for a review."""
    lines = scripts.select("name", F.explode(F.split("script", "\n")).alias("line")).where(F.col("line").rlike(f"-- *({REVIEW})"))
    return lines.select("name", F.regexp_extract("line", f"-- *({REVIEW})", 1).alias("kind"), F.trim(F.regexp_extract("line", "-- *(.*)$", 1)).alias("note"))
