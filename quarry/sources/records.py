"""Academic transcripts as text: courses over several lines, semesters, totals, and a check of the stated mean.

A line "code - NAME" opens a course; the next line that begins with "Docente:" closes it and holds its figures, in one of three shapes. What stands between, and figures that no course is open for,
counts for nothing; a semester's header holds until the next. Lines are put in order by a window within each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

#: Patterns of transcript lines. Figures: group, kind, hours, then with extension hours, without, or of activities that are fulfilled or not.
COURSE = r"^(\d{3,4}) - (.+?)$"
SEMESTER = r"ANO/SEM\s*\|\s*(\d{4})/(\d)\s*Coeficiente de Rendimento \(CR\):\s*([\d.,]+)"
FULL = r"Docente:.*?\s(\d{3})\s+(DF|DE|E|O|AE)\s+(\d+)\s+(\S+)\s+(\d+)\s+(\d+)\s+([\d,.]+)\s+([A-ZÃÕÇ ]+?)\s*$"
PLAIN = r"Docente:.*?\s(\d{3})\s+(DF|DE|E|O|AE)\s+(\d+)\s+(\d+)\s+(\d+)\s+([\d,.]+)\s+([A-ZÃÕÇ ]+?)\s*$"
FULFILLED = r"Docente:.*?\s(\d{3})\s+(DF|DE|E|O|AE)\s+(\d+)\s+(\d+)\s+(?:-\s+)?(CUMPRIDO|N[ÃA]O\s+CUMPRIDO|EM\s+CURSO)\s*$"
TOTALS = {
    "fixed_hours": r"(?m)^FIXAS\s+(\d+)\s*$", "elective_hours": r"(?m)^ELETIVAS\s+(\d+)\s*$", "hours": r"Total de horas cumpridas pelo estudante[^\d]*(\d+)",
    "extension_hours": r"Carga hor[áa]ria extensionista:\s*(\d+)\s*horas", "activity_hours": r"(?m)^ATIVIDADES COMPLEMENTARES\s+(\d+)\s*$", "entry_year": r"Ano de ingresso:\s*(\d{4})",
}
OVERALL, PROGRAMME = r"Coeficiente de Rendimento \(CR\) Geral:\s*([\d.,]+)", r"(?m)Curso:\s*(.+?)\s*$"
#: Fixed value: how far the mean may lie from the stated one.
WITHIN = 0.05


def number(c: Column) -> Column:
    """A number with a comma or a point; null for anything else."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def courses(files_: DataFrame) -> DataFrame:
    """(path, at, term, code, name, group, kind, hours, extension, credits, attendance, grade, status): the courses of each transcript, at their line. files: (path, content)."""
    lines = files_.select("path", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("at", "raw")).withColumn("line", text.strip("raw"))
    kind = F.when(F.col("line").rlike(SEMESTER), "semester").when(F.col("line").rlike(COURSE), "course").when(F.col("line").startswith("Docente:"), "figures")
    order = Window.partitionBy("path").orderBy("at")
    term = F.when(F.col("what") == "semester", F.regexp_replace(F.regexp_extract("line", SEMESTER, 0), rf"^{SEMESTER}$", "$1/$2"))
    marked = lines.withColumn("what", kind).where("what IS NOT NULL").withColumn("term", F.last(term, ignorenulls=True).over(order))
    turns = marked.where("what <> 'semester'")
    closed = turns.withColumns({"before": F.lag("what").over(order), "opened": F.lag("line").over(order)}).where("what = 'figures' AND before = 'course'")
    full, plain, done = (lambda g: F.regexp_extract("line", FULL, g)), (lambda g: F.regexp_extract("line", PLAIN, g)), (lambda g: F.regexp_extract("line", FULFILLED, g))
    shaped = closed.withColumn("shape", F.when(F.col("line").rlike(FULL), 0).when(F.col("line").rlike(PLAIN), 1).when(F.col("line").rlike(FULFILLED), 2)).where("shape IS NOT NULL")

    def by_shape(a: int | None, b: int | None, c: int | None) -> Column:
        return F.get(F.array(*(F.lit(None).cast("string") if g is None else f(g) for f, g in ((full, a), (plain, b), (done, c)))), F.col("shape"))

    return shaped.select(
        "path", "at", "term", F.regexp_extract("opened", COURSE, 1).alias("code"), F.initcap(text.strip(F.regexp_extract("opened", COURSE, 2))).alias("name"),
        by_shape(1, 1, 1).alias("group"), by_shape(2, 2, 2).alias("kind"), by_shape(3, 3, 3).cast("int").alias("hours"), F.coalesce(number(by_shape(4, None, None)), F.lit(0.0)).alias("extension"),
        by_shape(5, 4, 4).cast("int").alias("credits"), by_shape(6, 5, None).cast("int").alias("attendance"), number(by_shape(7, 6, None)).alias("grade"),
        F.regexp_replace(text.strip(by_shape(8, 7, 5)), r"\s+", " ").alias("status"),
    )


def semesters(files_: DataFrame) -> DataFrame:
    """(path, at, term, mean): the semesters of each transcript with the mean stated for each."""
    lines = files_.select("path", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("at", "line")).where(F.col("line").rlike(SEMESTER))
    part = lambda g: F.regexp_extract("line", SEMESTER, g)
    return lines.select("path", "at", F.concat(part(1), F.lit("/"), part(2)).alias("term"), number(part(3)).alias("mean"))


def summary(files_: DataFrame) -> DataFrame:
    """(path, programme, courses, credits, running, mean, stated, agrees, and the totals): one row for each transcript, also one without any course, whose mean is null.

    mean: of grades weighed with credits, of courses that have both; stated: the overall one in the text. agrees: whether they are within WITHIN; false if either is missing.
    """
    weighed, exact = F.col("grade").isNotNull() & (F.col("credits") > 0), F.col("grade").cast("decimal(12,4)")  # a sum in any order is the same
    by = courses(files_).groupBy("path").agg(
        F.count("*").alias("courses"), F.sum("credits").alias("credits"), F.count_if(F.col("status") == "EM CURSO").alias("running"),
        F.round(F.try_divide(F.sum(F.when(weighed, exact * F.col("credits"))).cast("double"), F.sum(F.when(weighed, F.col("credits"))).cast("double")), 3).alias("mean"),
    )
    found = lambda pattern: F.nullif(F.regexp_extract(F.coalesce("content", F.lit("")), pattern, 1), F.lit(""))
    stated = files_.select("path", text.strip(found(PROGRAMME)).alias("programme"), number(found(OVERALL)).alias("stated"), *(found(p).cast("int").alias(name) for name, p in TOTALS.items()))
    agrees = F.coalesce(F.abs(F.col("mean") - F.col("stated")) <= WITHIN, F.lit(False)).alias("agrees")
    none = F.lit(0).cast("long")
    return stated.join(by, "path", "left").select("path", "programme", F.coalesce("courses", none).alias("courses"), F.coalesce("credits", none).alias("credits"), F.coalesce("running", none).alias("running"), "mean", "stated", agrees, *TOTALS)
