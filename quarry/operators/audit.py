"""Rule audits over transcripts, activities and requirements, and the semester planner."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.lineage import checkpoint, shuffled
from quarry.operators.closure import depths

#: Courses of a programme that are packed into a block, and students of one whom such a block meets at a time.
COURSES, STUDENTS = 1024, 4096
#: Pairs of blocks of courses and students that a task makes rows of.
TILES = 4


def weighted_mean(lines: DataFrame, key: str = "student", grade: str = "grade", credits: str = "credits") -> DataFrame:
    """(key, gpa, credits): mean grade by credits, without null grades and zero credits, to 3 places."""
    some = lines.where(f"{grade} IS NOT NULL AND {credits} > 0")
    return some.groupBy(key).agg(F.round(F.sum(F.col(grade) * F.col(credits)) / F.sum(credits), 3).alias("gpa"), F.sum(credits).alias("credits"))


def what_if(lines: DataFrame, supposed: DataFrame) -> DataFrame:
    """The weighted mean with supposed lines (student, grade, credits) added."""
    return weighted_mean(lines.select("student", "grade", "credits").unionByName(supposed.select("student", "grade", "credits")))


def grade_needed(lines: DataFrame, credits: float, target: float, digits: int = 3) -> DataFrame:
    """(student, needed, possible): the grade on further credits that brings the mean to the target."""
    some = lines.where("grade IS NOT NULL AND credits > 0").groupBy("student").agg(F.sum(F.col("grade") * F.col("credits")).alias("points"), F.sum("credits").alias("c"))
    needed = F.round((target * (F.col("c") + credits) - F.col("points")) / credits, digits)
    return some.select("student", needed.alias("needed")).withColumn("possible", F.col("needed") <= 10)


def axis_audit(activities: DataFrame, caps: dict[str, float], least: float, total: float) -> DataFrame:
    """(student, hours, missing_axes, missing_hours): hours by axis, capped; axes below their least; hours missing in total.

    activities: (student, axis, hours); caps: most counted hours of each axis.
    """
    cap = F.lit(None).cast("double")
    for axis, most in caps.items():
        cap = F.when(F.col("axis") == axis, F.lit(float(most))).otherwise(cap)
    by_axis = activities.groupBy("student", "axis").agg(F.sum("hours").alias("hours")).withColumn("valid", F.least("hours", F.coalesce(cap, F.col("hours"))))
    return by_axis.groupBy("student").agg(
        F.round(F.sum("valid"), 4).alias("hours"),
        (F.lit(len(caps)) - F.count_if((F.col("valid") >= least) & F.col("axis").isin(*caps))).cast("int").alias("missing_axes"),
        F.round(F.greatest(F.lit(0.0), F.lit(total) - F.sum("valid")), 4).alias("missing_hours"),
    )


def capped_hours(activities: DataFrame, rules: DataFrame) -> DataFrame:
    """(student, kind, hours): sum of hours times the kind's factor, up to its ceiling. rules: (kind, factor, ceiling), small and fixed."""
    joined = activities.join(F.broadcast(rules), "kind")
    return joined.groupBy("student", "kind", "ceiling").agg(F.sum(F.col("hours") * F.col("factor")).alias("h")).select("student", "kind", F.round(F.least("h", "ceiling"), 4).alias("hours"))


def over_limit(activities: DataFrame, most: int = 2) -> DataFrame:
    """(student, institution, certificates): institutions with more certificates of a student than may count."""
    return activities.groupBy("student", "institution").agg(F.count("*").alias("certificates")).where(F.col("certificates") > most)


def progress(courses: DataFrame, passed: DataFrame, needs: DataFrame) -> DataFrame:
    """(student, programme, completed, pending, available, blocked): how a student stands in each programme they have begun.

    courses: (course, programme); passed: (student, course); needs: edges (src, dst). Only pending courses next to passed ones are looked at one by
    one; the rest follows from counts.
    """
    pairs = needs.select("src", "dst").distinct()
    size = courses.groupBy("programme").agg(F.count("*").alias("courses"))
    free = courses.join(pairs.select(F.col("dst").alias("course")).distinct(), "course", "left_anti")
    free_size = free.groupBy("programme").agg(F.count("*").alias("free"))
    done = passed.join(courses, "course")
    begun = done.groupBy("student", "programme").agg(F.count("*").alias("completed"))
    free_done = done.join(free.select("course"), "course", "left_semi").groupBy("student", "programme").agg(F.count("*").alias("free_done"))
    needed = pairs.groupBy("dst").agg(F.count("*").alias("needed"))
    have = passed.join(pairs, F.col("course") == F.col("src")).groupBy("student", "dst").agg(F.count("*").alias("n"))
    ready = have.join(needed, "dst").where("n = needed").select("student", F.col("dst").alias("course")).join(passed, ["student", "course"], "left_anti")
    opened = ready.join(courses, "course").groupBy("student", "programme").agg(F.count("*").alias("opened"))
    joined = begun.join(size, "programme").join(free_size, "programme", "left").join(free_done, ["student", "programme"], "left").join(opened, ["student", "programme"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    available = zero("opened") + zero("free") - zero("free_done")
    return joined.select(
        "student", "programme", "completed", (F.col("courses") - F.col("completed")).alias("pending"), available.alias("available"),
        (F.col("courses") - F.col("completed") - available).alias("blocked"),
    )


def progress_detail(taken: DataFrame, own: DataFrame, courses: DataFrame, needs: DataFrame) -> DataFrame:
    """(student, course, status, missing): each course of a student's programme and each taken one: done, available, blocked (with the missing prerequisites of the
    programme, sorted), elective (taken, of another programme) or unknown (taken, not in courses).

    taken: (student, course); own: (student, programme), one a student; courses: (course, programme); needs: edges (src, dst). A course stands alike for all students of a programme, but for those
    who had it or a prerequisite of it. Only these rows are shuffled; all others come from packed blocks of a programme's courses that meet blocks of its students, and go out as they are made: a course's
    row is worked out once a programme, and of a block only the students who had some of it have their rows looked at one by one.
    """
    known = checkpoint(courses.select("course", "programme").distinct())
    had = checkpoint(taken.select("student", "course").distinct())
    own = checkpoint(own.select("student", "programme"))
    pairs = needs.select("src", F.col("dst").alias("course")).distinct()
    # prerequisites of the same programme only
    inner = checkpoint(pairs.join(shuffled(known), "course").join(shuffled(known.toDF("src", "programme")), ["src", "programme"], "left_semi").select("src", "course", "programme"))
    done = checkpoint(had.join(shuffled(own), "student").join(shuffled(known), ["course", "programme"], "left_semi").select("student", "course", "programme"))
    begun = done.withColumnRenamed("course", "src").join(shuffled(inner), ["src", "programme"]).select("student", "course", "programme").distinct()
    begun = checkpoint(begun.join(shuffled(done.select("student", "course")), ["student", "course"], "left_anti").select("student", "course", "programme"))
    lacking = begun.join(shuffled(inner), ["course", "programme"]).join(shuffled(done.select("student", F.col("course").alias("src"))), ["student", "src"], "left_anti")
    listed = lambda rows, *by: rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("src")).cast("array<string>"), ",").alias("missing"))
    status, missing = F.when(F.col("missing").isNull(), "available").otherwise("blocked").alias("status"), F.coalesce("missing", F.lit("")).alias("missing")
    open_ = begun.join(shuffled(listed(lacking, "student", "course")), ["student", "course"], "left").select("student", "course", status, missing)
    others = had.join(shuffled(done.select("student", "course")), ["student", "course"], "left_anti").join(shuffled(known.select("course", F.lit(True).alias("known"))), "course", "left")
    rest = others.select("student", "course", F.when(F.col("known"), "elective").otherwise("unknown").alias("status"), F.lit("").alias("missing"))
    # all other courses of a student's programme: blocks of courses meet blocks of students
    most = lambda rows: rows.groupBy("programme").count().agg(F.max("count"), F.count("*")).first()
    (courses_, programmes), (students, _) = most(known), most(own)
    blocks, teams = (max(1, -(-(n or 0) // size)) for n, size in ((courses_, COURSES), (students, STUDENTS)))
    block, team = F.pmod(F.xxhash64("course"), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64("student"), F.lit(teams)).alias("team")
    all_ = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    by, parts = ["programme", "block", "team"], max(known.sparkSession.sparkContext.defaultParallelism, programmes * blocks * teams // TILES)
    alike = known.join(shuffled(listed(inner, "course", "programme")), ["course", "programme"], "left")
    packed = alike.groupBy("programme", block).agg(F.collect_list(F.struct("course", status, missing)).alias("rows"))
    packed = checkpoint(packed.select("programme", "block", "rows", all_(teams).alias("team")).repartition(parts, *by))
    but = done.unionAll(begun).groupBy("student", "programme", block).agg(F.collect_list("course").alias("but"))
    without = own.select("student", "programme", all_(blocks).alias("block")).join(shuffled(but), ["student", "programme", "block"], "left_anti")
    meet = lambda rows: rows.withColumn("team", team).repartition(parts, *by).join(shuffled(packed), by)
    left = lambda r: ~F.coalesce(F.array_contains("but", r["course"]), F.lit(False))
    touched = meet(but).select("student", F.explode(F.filter("rows", left)).alias("r")).select("student", "r.course", "r.status", "r.missing")
    flat = done.select("student", "course", F.lit("done").alias("status"), F.lit("").alias("missing")).unionAll(rest).unionAll(open_)
    return flat.unionAll(touched).unionAll(meet(without).select("student", F.inline("rows")))


def pending_semesters(pending: DataFrame, needs: DataFrame) -> DataFrame:
    """(student, semesters): the least number of semesters for a student's pending courses: the longest chain of prerequisites among them. Courses of a cycle, and those behind one, count as none:
    cycles.pending_cycles reports them, also for a student without a row here.

    pending: (student, course).
    """
    pairs = needs.select("src", F.col("dst").alias("course")).distinct()
    rows = checkpoint(pending.select("student", "course").distinct())
    inner = rows.join(shuffled(pairs), "course").join(shuffled(rows.withColumnRenamed("course", "src")), ["student", "src"], "left_semi")
    # students' graphs stay apart by a column of their own, and of each only its longest path is asked
    longest = depths(inner.select("student", "src", F.col("course").alias("dst")), rows.select("student", F.col("course").alias("node")), "student")
    return longest.select("student", (F.col("depth") + 1).alias("semesters"))


def enrolment_advice(wanted: DataFrame, passed: DataFrame, needs: DataFrame, base: DataFrame, parity: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """(student, course, status, taken, missing, base, parity): what speaks against enrolling: risk (taken already, or prerequisites missing), ok, or unknown; and up to
    `most` recommended courses that the student lacks, best first, which don't. base: (course, base, rank); parity: (course, parity); known: (course)."""
    checked = enrolment_check(wanted, passed, needs)
    lacks = wanted.join(base, "course").join(passed.withColumnRenamed("course", "base"), ["student", "base"], "left_anti")
    order = F.row_number().over(Window.partitionBy("student", "course").orderBy("rank", "base"))
    soft = lacks.withColumn("r", order).where(F.col("r") <= most).groupBy("student", "course").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "base"))), lambda s: s["base"].cast("string")).alias("soft"))
    out = checked.join(soft, ["student", "course"], "left").join(parity, "course", "left").join(known.select("course", F.lit(True).alias("known")).distinct(), "course", "left")
    status = F.when(F.col("known").isNull(), "unknown").when(F.col("taken") | (F.col("missing") != ""), "risk").otherwise("ok")
    return out.select("student", "course", status.alias("status"), "taken", "missing", F.coalesce(F.array_join("soft", ","), F.lit("")).alias("base"), "parity")


def enrolment_check(wanted: DataFrame, passed: DataFrame, needs: DataFrame) -> DataFrame:
    """(student, course, taken, missing): whether a wanted course was passed already, and which prerequisites are missing (sorted)."""
    pairs = needs.select("src", F.col("dst").alias("course")).distinct()
    open_ = wanted.join(pairs, "course").join(passed.withColumnRenamed("course", "src"), ["student", "src"], "left_anti")
    missing = open_.groupBy("student", "course").agg(F.array_join(F.array_sort(F.collect_set("src")).cast("array<string>"), ",").alias("missing"))
    taken = passed.select("student", "course", F.lit(True).alias("taken"))
    return wanted.join(missing, ["student", "course"], "left").join(taken, ["student", "course"], "left").select(
        "student", "course", F.coalesce("taken", F.lit(False)).alias("taken"), F.coalesce("missing", F.lit("")).alias("missing")
    )


def requirement_seed(students: DataFrame, seeds: DataFrame, evening: str = "noturno", day: str = "integral") -> DataFrame:
    """(student, seed): the seed of requirements for each student's programme: of those of its acronym the one of its shift, else the first. Students whose acronym has none have no row.

    students: (student, acronym, programme), whose text names the evening shift or is of the day; seeds: (acronym, shift, at, seed), at their order.
    """
    wanted = students.select("student", F.upper(F.coalesce("acronym", F.lit(""))).alias("acronym"), F.when(F.contains(text.fold(F.coalesce("programme", F.lit(""))), F.lit(evening)), evening).otherwise(day).alias("shift"))
    known = seeds.select("acronym", F.col("shift").alias("of"), "at", "seed")
    best = F.struct((F.col("of") != F.col("shift")).alias("other"), F.col("at"))
    return wanted.join(known, "acronym").groupBy("student").agg(F.min_by("seed", best).alias("seed"))


def plan_events(plan: DataFrame) -> DataFrame:
    """(student, seq, event, payload): a plan told step by step, as rows of JSON: start, a semester each with its courses, and done with the totals. plan: (student, semester, course, credits)."""
    by = plan.groupBy("student", "semester").agg(F.array_sort(F.collect_list("course")).alias("courses"), F.sum("credits").cast("long").alias("credits"))
    order = Window.partitionBy("student").orderBy("semester")
    each = by.select("student", F.row_number().over(order).cast("long").alias("seq"), F.lit("semester").alias("event"), F.to_json(F.struct("semester", "courses", "credits")).alias("payload"))
    whole = by.groupBy("student").agg(F.count("*").alias("semesters"), F.sum(F.size("courses")).alias("courses"), F.sum("credits").alias("credits"))
    start = whole.select("student", F.lit(0).cast("long"), F.lit("start"), F.to_json(F.struct("semesters")))
    done = whole.select("student", (F.col("semesters") + 1), F.lit("done"), F.to_json(F.struct("courses", "credits")))
    return each.unionAll(start).unionAll(done)


def requirement_matrix(requirements: DataFrame, accomplished: DataFrame) -> DataFrame:
    """(student, requirement, required, done, met): met is true, false, or null where nothing is known.

    requirements: (requirement, required), a fixed small table; accomplished: (student, requirement, done).
    """
    students = accomplished.select("student").distinct()
    wide = students.crossJoin(F.broadcast(requirements))
    return wide.join(accomplished, ["student", "requirement"], "left").select("student", "requirement", "required", "done", (F.col("done") >= F.col("required")).alias("met"))


def leading_terms(status: DataFrame) -> DataFrame:
    """(student, terms): how many terms from the first on are completed without a gap. status: (student, term, ok)."""
    failed = F.min(F.when(~F.col("ok"), F.col("term")))
    return status.groupBy("student").agg(F.coalesce(failed - 1, F.max("term")).alias("terms"))


def offer_parity(offers: DataFrame) -> DataFrame:
    """(course, parity): odd, even or both, by the terms a course is offered in; null terms don't count. offers: (course, term)."""
    some = offers.groupBy("course").agg(F.bool_or(F.col("term") % 2 == 1).alias("odd"), F.bool_or(F.col("term") % 2 == 0).alias("even"))
    kind = F.when(F.col("odd") & F.col("even"), "both").when(F.col("odd"), "odd").when(F.col("even"), "even")
    return some.select("course", kind.alias("parity"))


def grade_band(grade: Column) -> Column:
    return F.when(grade.isNull(), None).when(grade >= 5, "passed").otherwise("failed")


PLAN = "student long, semester int, course long, credits int, term int"
PLAN_SCHEMA = pa.schema([("student", pa.int64()), ("semester", pa.int32()), ("course", pa.int64()), ("credits", pa.int32()), ("term", pa.int32())])


def plan_elements(plan: DataFrame, passed: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A plan as a graph: nodes (student, course, semester), semester 0 for passed courses, and edges (student, src, dst) between courses that are both there, each once."""
    nodes = plan.select("student", "course", "semester").unionAll(passed.join(plan.select("student").distinct(), "student", "left_semi").select("student", "course", F.lit(0))).groupBy("student", "course").agg(F.min("semester").alias("semester"))
    pairs = needs.select("src", F.col("dst").alias("course")).distinct()
    ends = nodes.select("student", "course")
    edges = ends.join(pairs, "course").join(ends.withColumnRenamed("course", "src"), ["student", "src"], "left_semi").select("student", "src", F.col("course").alias("dst"))
    return nodes, edges


def plan_semesters(pending: DataFrame, needs: DataFrame, cap: int, first: int = 1, most: int = 20) -> DataFrame:
    """(student, semester, course, credits, term): a greedy plan of each student's pending courses.

    pending: (student, course, credits, term). A semester takes courses whose prerequisites are passed or planned before, of its parity (odd terms in
    odd semesters), by term, credits (high first) and id, while they fit the cap; at least one is always placed. Planning stops
    after `most` semesters or three empty ones in a row. Each step needs the one before it, so a student is one group; groups are
    as small as one student's pending courses. Only prerequisites that are pending too are joined in.
    """
    inner = needs.select("src", F.col("dst").alias("course")).distinct().join(pending.select("student", "course"), "course")
    both = inner.join(pending.select("student", F.col("course").alias("src")), ["student", "src"], "left_semi")
    before = both.groupBy("student", "course").agg(F.collect_set("src").alias("before"))
    rows = pending.join(before, ["student", "course"], "left")
    inline = F.struct("term", (-F.col("credits")).alias("less"), "course", "credits", "before")
    students = rows.groupBy("student").agg(F.sort_array(F.collect_list(inline)).alias("pending"))

    def plan(courses: list[dict]) -> list[tuple[int, dict]]:
        left = {c["course"]: c for c in courses}
        done, out, empty = set(), [], 0
        for semester in range(first, first + most):
            used, taken = 0, []
            for c in left.values():
                if c["term"] % 2 == semester % 2 and done.issuperset(c["before"] or ()) and (not taken or used + c["credits"] <= cap):
                    used += c["credits"]
                    taken.append(c)
            for c in taken:
                out.append((semester, c))
                del left[c["course"]]
            done |= {c["course"] for c in taken}
            empty = 0 if taken else empty + 1
            if not left or empty == 3:
                break
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r["student"], at, c["course"], c["credits"], c["term"]) for r in batch.to_pylist() for at, c in plan(r["pending"])]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(PLAN_SCHEMA.types)], schema=PLAN_SCHEMA)

    return students.mapInArrow(run, PLAN)
