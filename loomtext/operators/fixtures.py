"""Checks of test corpora: cases against their manifest and against the sections of a document. Native joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sections of the compatibility corpus and the constructs that each is about.
SECTIONS = {
    "Tabs": ("tabs",), "Backslash escapes": ("escapes",), "Precedence": ("precedence",), "Thematic breaks": ("rules",), "ATX headings": ("headings",), "Setext headings": ("setext",),
    "Indented code blocks": ("indented code",), "Fenced code blocks": ("fences",), "HTML blocks": ("html",), "Block quotes": ("quotes", "quote depth"), "List items": ("lists", "marker indentation"),
    "Lists": ("lists", "marker indentation"), "Link reference definitions": ("definitions", "reference links"), "Paragraphs": ("paragraphs",), "Blank lines": ("paragraphs",), "Inlines": ("code spans", "unclosed marks"),
    "Code spans": ("code spans",), "Emphasis and strong emphasis": ("emphasis", "same-kind nesting"), "Links": ("links", "link context", "unclosed marks"), "Images": ("links", "link context", "unclosed marks"),
    "Autolinks": ("autolinks",), "Raw HTML": ("html",), "Hard line breaks": ("breaks", "multiline spans"), "Soft line breaks": ("breaks",), "Entity and numeric character references": ("entities",),
    "Textual content": ("text",), "Tables (extension)": ("tables",), "Strikethrough (extension)": ("deletions",), "Task list items (extension)": ("tasks",), "Autolinks (extension)": ("bare urls",),
}
#: Node kinds of the corpus's own reading that outweigh the section, the first that is there, and their constructs.
OUTER = (("html", ("html",)), ("definition", ("definitions", "reference links")), ("linkReference", ("definitions", "reference links")), ("imageReference", ("definitions", "reference links")), ("table", ("tables",)), ("blockquote", ("quotes",)), ("list", ("lists", "marker indentation")))


def repeated_ids(cases: DataFrame) -> DataFrame:
    """Case ids that stand twice or more."""
    return cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def source_faults(cases: DataFrame, free_groups: tuple[str, ...] = ("transport",)) -> DataFrame:
    """Sources with other line ends than LF, or without exactly one final one, outside of the byte-exact groups."""
    why = F.when(F.col("source").contains("\r"), "CR").when(~F.col("source").rlike(r"[^\n]\n\z|\A\n\z"), "final line feed")
    return cases.where(~F.col("group").isin(*free_groups)).select("group", "id", why.alias("fault")).where("fault is not null")


def count_faults(cases: DataFrame, manifest: DataFrame) -> DataFrame:
    """Groups whose number of cases is not what the manifest ``(group, n)`` says; missing groups count 0."""
    have = cases.groupBy("group").agg(F.count(F.lit(1)).alias("n_cases"))
    both = manifest.withColumnRenamed("n", "n_expected").join(have, "group", "full_outer")
    both = both.select("group", F.coalesce("n_expected", F.lit(0)).cast("bigint").alias("n_expected"), F.coalesce("n_cases", F.lit(0)).alias("n_cases"))
    return both.where("n_expected <> n_cases")


def uncovered_sections(cases: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections that no case names in its comma-separated ``spec``."""
    named = cases.select(F.explode(F.split("spec", r"\s*,\s*")).alias("section")).distinct()
    return sections.join(named, "section", "left_anti")


def promoted(candidates: DataFrame, outcomes: DataFrame, wanted: str = "canonical") -> DataFrame:
    """Candidates whose outcome is the wanted one, ready to be written as cases."""
    return candidates.join(outcomes.where(F.col("outcome") == wanted).select("id"), "id", "left_semi")


def routed(cases: DataFrame) -> DataFrame:
    """Cases ``(id, section, kinds)`` as one row for each construct that they are about.

    ``kinds`` are the node kinds that the corpus's own reader finds; some of them outweigh
    the section.  A section that is not listed gives no row.
    """
    literal = lambda names: F.array(*map(F.lit, names))
    of = F.create_map(*[x for k, v in SECTIONS.items() for x in (F.lit(k), literal(v))])[F.col("section")]
    outer = F.lit(None)
    for kind, names in reversed(OUTER):
        outer = F.when(F.array_contains("kinds", kind), literal(names)).otherwise(outer)
    found = F.when(F.col("section").isin("HTML blocks", "Raw HTML"), of).otherwise(F.coalesce(outer, of))
    return cases.select("id", "section", F.explode(found).alias("construct"))


def classified(cases: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Cases ``(id, section, skeleton, expected, stable)`` against a rule catalogue ``(section, behaviour)``.

    same: equal skeletons; reject: the catalogue says the construct is refused; structural:
    other blocks on purpose; import-only: only an import keeps it; n/a: not part of the language.
    """
    joined = cases.join(F.broadcast(catalogue), "section", "left")  # a catalogue has some dozens of rows
    status = (
        F.when(F.col("skeleton").eqNullSafe(F.col("expected")), "same").when(F.col("behaviour") == "reject", "reject").when(F.col("behaviour") == "structural", "structural")
        .when((F.col("behaviour") == "import") & F.col("stable"), "import-only").when(F.col("behaviour") == "none", "n/a").otherwise("fail")
    )
    return joined.select("id", "section", status.alias("status"))


def gate(buckets: DataFrame) -> DataFrame:
    """Totals for each bucket of a migration gate and over all."""
    return buckets.rollup("bucket").agg(F.count(F.lit(1)).alias("n"))


def facts(cases: DataFrame) -> DataFrame:
    """Measured facts of a corpus: cases, groups, valid cases."""
    return cases.agg(F.count(F.lit(1)).alias("n_cases"), F.count_distinct("group").alias("n_groups"), F.count_if("valid").alias("n_valid"))
