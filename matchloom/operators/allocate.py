"""Capacity allocation.

Greedy choice with shared capacity is sequential only inside a connected component of
the class - pool graph. The steps:

1. students get a dense order number (distributed radix numbering);
2. classes and pool rows meet in buckets (``matching``), never in pairs;
3. components come from min-label rounds over the class/mentor - bucket incidence list,
   checkpointed each round;
4. a class never uses more students than its buckets have places, so later students of
   the class leave before the fold (exact, see ``_trim``);
5. each component's rows stream, in order, through one task that keeps one heap per
   bucket and two integers per mentor; batches are consumed as they arrive, so memory
   follows the component's pool rows and not its students.

Isolated buckets need no fold at all: ``allocate_isolated`` is a slot join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.config import KEYS, Policy
from matchloom.functions.ids import natural_key
from matchloom.operators import matching as M
from matchloom.operators.matrix_core import capacity_outcome
from matchloom.operators.numbering import lookup, number_rows
from matchloom.session import cut_lineage

FOLD_OUT = (
    "kind string, ord bigint, mentor_id string, pool_order bigint, capacity_before bigint, "
    "capacity_after bigint, error_type string, manager_pass string"
)


def priority_index(center: Column, policy: Policy) -> Column:
    """Position of the (defaulted) center in the priority list; others last."""
    value = F.coalesce(center, F.lit(policy.default_center))
    out = F.lit(len(policy.center_priority))
    for i, c in reversed(list(enumerate(policy.center_priority))):
        out = F.when(value == c, F.lit(i)).otherwise(out)
    return out


def student_order(
    students: DataFrame, policy: Policy | None = None, school: str | None = "is_school_student", priorities: DataFrame | None = None
) -> DataFrame:
    """Dense ``order_no``: school students first, then center priority, then id.

    ``priorities`` (center_code, priority) takes the place of the policy's order; centers outside it are last.
    """
    policy = policy or Policy()
    is_school = F.coalesce(F.col(school), F.lit(False)) if school and school in students.columns else F.lit(False)
    df = students.withColumn("phase", F.when(is_school, 0).otherwise(1))
    if priorities is None:
        df = df.withColumn("priority", priority_index(F.col("center_code"), policy))
    else:
        keyed = df.withColumn("__center", F.coalesce("center_code", F.lit(policy.default_center)).cast("bigint"))
        listed = priorities.select(F.col("center_code").alias("__center"), F.col("priority").cast("int").alias("priority"))
        df = lookup(keyed, listed, ["__center"], ["priority"], "left").drop("__center")
        df = df.withColumn("priority", F.coalesce("priority", F.lit((1 << 31) - 1)))
    numeric = dict(df.dtypes)["student_id"] in ("bigint", "int", "smallint", "tinyint")
    fine = F.floor(F.col("student_id") / 4096) if numeric else F.substring("student_id", 1, 6)
    coarse = F.floor(F.col("student_id") / (1 << 24)) if numeric else F.substring("student_id", 1, 3)
    levels = [("__b", F.struct("phase", "priority", coarse.alias("coarse"))), ("__f", fine)]
    return number_rows(df, [F.col("phase"), F.col("priority"), F.col("student_id")], levels, name="order_no")


def phase_counts(students: DataFrame, pool: DataFrame, school: str = "is_school_student") -> DataFrame:
    """Students per phase and places at the start."""
    s = students.agg(
        F.count_if(F.coalesce(F.col(school), F.lit(False))).cast("bigint").alias("school_students"),
        F.count_if(~F.coalesce(F.col(school), F.lit(False))).cast("bigint").alias("center_students"),
    )
    p = pool.agg(F.coalesce(F.sum("remaining_capacity"), F.lit(0)).cast("bigint").alias("places"))
    return s.join(F.broadcast(p))


def components(incidence: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, bucket) -> (bucket, component): smallest reachable label.

    A label is a hash; two components that collide are folded together, which costs
    parallelism and never correctness.
    """
    edges = cut_lineage(incidence.select("node", "bucket").distinct())
    labels = edges.select("bucket").distinct().withColumn("component", F.xxhash64("bucket"))
    for _ in range(max_rounds):
        nodes = edges.join(labels, "bucket").groupBy("node").agg(F.min("component").alias("low"))
        nxt = edges.join(nodes, "node").groupBy("bucket").agg(F.min("low").alias("low"))
        step = cut_lineage(
            labels.join(nxt, "bucket").select("bucket", F.least("low", "component").alias("component"), (F.col("low") < F.col("component")).alias("moved"))
        )
        labels = step.select("bucket", "component")
        if step.where("moved").isEmpty():
            return labels
    raise RuntimeError("component labels did not settle")


def _fold(rows: DataFrame, row_gate: str) -> DataFrame:
    """Stream ordered (component, kind, ord) rows through the greedy choice."""
    by_row = row_gate == "chosen_row"

    def run(batches):
        import heapq

        import pandas as pd

        current, rows, state, heaps, preferred, has_pref = None, {}, {}, {}, {}, set()
        out = []

        def flush():
            for order, r in rows.items():
                out.append(("p", order, r[0], order, state[r[0]][0], r[1], None, None))

        def best(heap):
            while heap:
                key = heap[0]
                row = rows[key[3]]
                st = state[row[0]]
                if (row[1] if by_row else st[0]) <= 0:
                    heapq.heappop(heap)
                    continue
                now = (-st[0], st[1], st[2], key[3])
                if now != key:
                    heapq.heapreplace(heap, now)
                    continue
                return key
            return None

        def pick(heap_map, buckets):
            found = None
            for b in buckets:
                heap = heap_map.get(b)
                if heap:
                    key = best(heap)
                    if key is not None and (found is None or key < found):
                        found = key
            return found

        for pdf in batches:
            for comp, kind, order, bucket, buckets, mentor, sort, cap, initial, new, pref, phase, center in zip(
                pdf["component"], pdf["kind"], pdf["ord"], pdf["bucket"], pdf["buckets"], pdf["mentor_id"],
                pdf["mentor_sort"], pdf["row_cap"], pdf["initial"], pdf["new"], pdf["preferred"], pdf["phase"], pdf["center"],
            ):
                if comp != current:
                    flush()
                    current, rows, state, heaps, preferred, has_pref = comp, {}, {}, {}, {}, set()
                order = int(order)
                if kind == 0:
                    if order not in rows:
                        rows[order] = [mentor, int(cap)]
                        state.setdefault(mentor, [int(initial), int(new), sort])
                    st = state[mentor]
                    key = (-st[0], st[1], st[2], order)
                    opened = (rows[order][1] if by_row else st[0]) > 0
                    if opened:
                        heapq.heappush(heaps.setdefault(bucket, []), key)
                    if pref:
                        has_pref.add(bucket)
                        if opened:
                            heapq.heappush(preferred.setdefault(bucket, []), key)
                    continue
                chosen, mode = None, None
                if phase == 1:
                    mode = "full"
                    mine = [b for b in buckets if b in has_pref and b.split("|")[3] == center]
                    if mine:
                        mode = "preferred"
                        chosen = pick(preferred, mine)
                        if chosen is None:
                            mode = "fallback"
                if chosen is None:
                    chosen = pick(heaps, buckets)
                if chosen is None:
                    out.append(("d", order, None, None, None, None, "CAPACITY_FULL", mode))
                    continue
                row = rows[chosen[3]]
                st = state[row[0]]
                if st[0] <= 0:
                    out.append(("d", order, None, None, st[0], st[0], "CAPACITY_UNDERFLOW", mode))
                    continue
                before = st[0]
                st[0] -= 1
                st[1] += 1
                row[1] = st[0]
                out.append(("d", order, row[0], chosen[3], before, st[0], None, mode))
            if out:
                yield pd.DataFrame(out, columns=["kind", "ord", "mentor_id", "pool_order", "capacity_before", "capacity_after", "error_type", "manager_pass"])
                out.clear()
        flush()
        if out:
            yield pd.DataFrame(out, columns=["kind", "ord", "mentor_id", "pool_order", "capacity_before", "capacity_after", "error_type", "manager_pass"])

    placed = rows.repartition("component").sortWithinPartitions("component", "kind", "ord")
    return placed.mapInPandas(run, FOLD_OUT)


@dataclass
class Allocation:
    """Outcome of one run."""

    decisions: DataFrame
    pool_after: DataFrame
    component_sizes: DataFrame


def _trim(ordered: DataFrame, places: DataFrame) -> DataFrame:
    """Mark students that cannot get a place: their class has used up its buckets.

    The first ``places`` students of a class either took all places of its buckets or met
    them exhausted; places never return.
    """
    ranked = number_rows(ordered, [F.col("order_no")], [("__q", F.floor(F.col("order_no") / 65536))], by=["class_key"], name="class_no")
    out = lookup(ranked, places, ["class_key"], ["places"], "left")
    return out.withColumn("late", F.col("class_no") > F.coalesce("places", F.lit(0)))


def _run(
    ordered: DataFrame, class_buckets: DataFrame, pool_rows: DataFrame, row_gate: str, can_trim: bool
) -> Allocation:
    """Common executor: ``ordered`` has class_key / order_no / phase / center_code."""
    used = class_buckets.select("bucket").distinct()
    pool_rows = cut_lineage(pool_rows.join(used, "bucket", "left_semi"))
    live = pool_rows.select("bucket").distinct()
    class_buckets = cut_lineage(class_buckets.join(live, "bucket", "left_semi"))
    incidence = class_buckets.select(F.concat(F.lit("c:"), "class_key").alias("node"), "bucket").unionByName(
        pool_rows.select(F.concat(F.lit("m:"), "mentor_id").alias("node"), "bucket")
    )
    comp = components(incidence)
    per_class = lookup(class_buckets, comp, ["bucket"], ["component"]).groupBy("class_key").agg(
        F.min("component").alias("component"), F.array_sort(F.collect_set("bucket")).alias("buckets")  # at most six
    )
    usable = F.col("row_cap") > 0 if row_gate == "chosen_row" else F.lit(True)
    room = pool_rows.groupBy("bucket").agg(F.sum(F.when(usable, F.col("initial")).otherwise(0)).alias("room"))
    places = lookup(class_buckets, room, ["bucket"], ["room"]).groupBy("class_key").agg(F.sum("room").alias("places"))
    students = lookup(_trim(ordered, places) if can_trim else ordered.withColumn("late", F.lit(False)),
                      per_class, ["class_key"], ["component", "buckets"], "left")
    none = lambda t: F.lit(None).cast(t)
    supply = lookup(pool_rows, comp, ["bucket"], ["component"]).select(
        "component", F.lit(0).alias("kind"), F.col("pool_order").alias("ord"), "bucket", none("array<string>").alias("buckets"),
        "mentor_id", "mentor_sort", "row_cap", "initial", "new", "preferred", F.lit(0).alias("phase"), none("string").alias("center"),
    )
    demand = students.where(F.col("component").isNotNull() & ~F.col("late")).select(
        "component", F.lit(1).alias("kind"), F.col("order_no").alias("ord"), none("string").alias("bucket"), "buckets",
        none("string").alias("mentor_id"), none("string").alias("mentor_sort"), *[none("bigint").alias(c) for c in ("row_cap", "initial", "new")],
        none("boolean").alias("preferred"), "phase", F.col("center_code").cast("string").alias("center"),
    )
    folded = cut_lineage(_fold(supply.unionByName(demand), row_gate))
    pool_after = folded.where("kind = 'p'").select(
        "pool_order", "mentor_id", F.col("capacity_before").alias("mentor_remaining"), F.col("capacity_after").alias("row_remaining")
    )
    # Late students: exhausted for certain; a stale row decides which error they report.
    stale = lookup(class_buckets, lookup(pool_rows, pool_after, ["pool_order"], ["row_remaining"], "left").groupBy("bucket").agg(
        F.max(F.coalesce("row_remaining", "row_cap")).alias("left_over")), ["bucket"], ["left_over"])
    stale = stale.groupBy("class_key").agg((F.max("left_over") > 0).alias("stale"))
    made = folded.where("kind = 'd'").select(
        F.col("ord").alias("order_no"), "mentor_id", F.col("pool_order").alias("chosen_row"), "capacity_before", "capacity_after", "error_type", "manager_pass"
    )
    out = lookup(students, made, ["order_no"], [c for c in made.columns if c != "order_no"], "left")
    out = lookup(out, stale, ["class_key"], ["stale"], "left")
    late_code = F.when(F.col("stale") & F.lit(row_gate == "chosen_row"), F.lit("CAPACITY_UNDERFLOW")).otherwise(F.lit("CAPACITY_FULL"))
    error = F.when(F.col("component").isNull(), F.lit("ELIGIBILITY_NO_MATCH")).when(F.col("late"), late_code).otherwise(F.col("error_type"))
    decisions = out.withColumn("error_type", error).withColumn(
        "allocation_status", F.when(F.col("mentor_id").isNotNull(), F.lit("success")).otherwise(F.lit("failed"))
    )
    sizes = per_class.groupBy("component").agg(F.count(F.lit(1)).alias("classes"))
    keep = [c for c in ordered.columns if c not in ("class_key", "priority")]
    return Allocation(
        decisions.select(*keep, "mentor_id", "chosen_row", "capacity_before", "capacity_after", "error_type", "manager_pass", "allocation_status"),
        pool_after, sizes,
    )


def allocate(
    students: DataFrame, pool: DataFrame, policy: Policy | None = None, row_gate: str = "chosen_row",
    preferred: str | None = None, school: str = "is_school_student",
) -> Allocation:
    """Two phases, deterministic order, best candidate first, one place per success.

    ``row_gate='chosen_row'`` keeps the row-level capacity gate of the source rules (only
    the chosen row is updated); ``'mentor'`` gates on the mentor. ``preferred`` names a
    boolean pool column: rows of the center's configured managers, tried first in the
    center phase.
    """
    policy = policy or Policy()
    ordered = cut_lineage(student_order(students, policy, school).withColumn("class_key", M.class_key()))
    class_buckets = M.with_bucket(M.student_keys(M.student_classes(ordered).select("class_key", *KEYS), policy)).select("class_key", "bucket")
    flag = F.coalesce(F.col(preferred), F.lit(False)) if preferred else F.lit(False)
    rows = M.ranked_pool(pool).withColumn("preferred", flag)
    rows = M.with_bucket(M.pool_keys(rows, policy)).where(F.col("bucket").isNotNull()).select(
        "bucket", "pool_order", F.col("mentor_id").cast("string").alias("mentor_id"), "mentor_sort",
        F.greatest(F.coalesce("remaining_capacity", F.lit(0)), F.lit(0)).cast("bigint").alias("row_cap"), "initial",
        F.lit(0).cast("bigint").alias("new"), "preferred",
    )
    return _run(ordered, class_buckets, rows, row_gate, can_trim=not (preferred and row_gate == "chosen_row"))


def allocate_loop(students: DataFrame, mentors: DataFrame) -> Allocation:
    """Strict path: students in ascending id, plain finance, capacity outcome gate."""
    cap = capacity_outcome(mentors)
    numbered = number_rows(
        students, [F.col("student_id")], [("__c", F.floor(F.col("student_id") / (1 << 24))), ("__f", F.floor(F.col("student_id") / 4096))], name="order_no"
    )
    ordered = cut_lineage(numbered.withColumn("phase", F.lit(0)).withColumn("class_key", M.class_key()))
    zero = F.lit(0).cast("bigint")
    both = lambda c: F.explode(F.array_distinct(F.array(F.col(c), zero)))
    text = lambda *cs: F.concat_ws("|", *[F.col(c).cast("string") for c in cs])
    keyed = M.student_classes(ordered).withColumn("cc", both("center_code")).withColumn("sc", both("school_code"))
    class_buckets = keyed.select("class_key", text("group_code", "gender_code", "grad_status_code", "cc", "finance_code", "sc").alias("bucket"))
    rows = cap.where("capacity_ok").select(
        text("group_code", "gender_code", "grad_status_code", "center_code", "finance_code", "school_code").alias("bucket"),
        "pool_order", F.col("mentor_id").cast("string").alias("mentor_id"), natural_key("mentor_id").alias("mentor_sort"),
        F.col("remaining_capacity").alias("row_cap"), F.col("remaining_capacity").alias("initial"),
        F.col("allocations_new").alias("new"), F.lit(False).alias("preferred"),
    )
    return _run(ordered, class_buckets, rows, "mentor", can_trim=True)


def allocate_isolated(students: DataFrame, mentors: DataFrame, bucket: str, order: str) -> DataFrame:
    """Closed form for buckets whose mentors serve no other bucket.

    Every mentor becomes one slot per place; slots sorted by (remaining desc, new asc, id)
    are exactly the greedy picks, so the n-th student takes the n-th slot.
    """
    slots = mentors.where(F.col("remaining_capacity") > 0).withColumn(
        "left_places", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("remaining_capacity")))
    )
    slots = slots.withColumn("load", F.col("allocations_new") + F.col("remaining_capacity") - F.col("left_places"))
    slots = slots.withColumn("mentor_sort", natural_key("mentor_id"))
    slots = number_rows(
        slots, [F.col("left_places").desc(), F.col("load"), F.col("mentor_sort")],
        [("__r", -F.col("left_places")), ("__l", F.col("load")), ("__p", F.substring("mentor_sort", 1, 7))], by=[bucket], name="n",
    )
    queue = number_rows(students, [F.col(order)], [("__q", F.floor(F.col(order) / 4096))], by=[bucket], name="n")
    return lookup(queue, slots, [bucket, "n"], ["mentor_id", "left_places"], "left").withColumnRenamed("left_places", "capacity_before").drop("n")


def pool_after(pool: DataFrame, alloc: DataFrame) -> DataFrame:
    """Remaining and new per mentor after a run, never negative."""
    used = alloc.where(F.col("mentor_id").isNotNull()).groupBy("mentor_id").agg(F.count(F.lit(1)).alias("assigned"))
    state = M.mentor_state(pool)
    out = lookup(state, used, ["mentor_id"], ["assigned"], "left")
    n = F.coalesce("assigned", F.lit(0))
    return out.select(
        "mentor_id", F.greatest(F.col("initial") - n, F.lit(0)).cast("bigint").alias("remaining_capacity"),
        F.least(n, F.col("initial")).cast("bigint").alias("allocations_new"),
    )


def failure_class(log: DataFrame) -> DataFrame:
    """Failure type from the funnel counts (``n_<stage>``) of a failed attempt."""
    from matchloom.config import STAGES

    no_match = F.lit(False)
    for s in STAGES[:-1]:
        no_match = no_match | (F.coalesce(F.col(f"n_{s}"), F.lit(0)) == 0)
    code = (
        F.when(F.col("data_missing"), F.lit("DATA_MISSING"))
        .when(no_match, F.lit("ELIGIBILITY_NO_MATCH"))
        .when(F.coalesce("n_capacity_gate", F.lit(0)) == 0, F.lit("CAPACITY_FULL"))
        .when(F.coalesce("state_remaining", F.lit(0)) <= 0, F.lit("CAPACITY_UNDERFLOW"))
        .otherwise(F.lit("INTERNAL_ERROR"))
    )
    return log.withColumn("error_type", code)


def final_status(log: DataFrame) -> DataFrame:
    """Outcome label per student from status, error type, candidates and rule reason."""
    ok = F.lower(F.coalesce("allocation_status", F.lit(""))) == "success"
    bad_data = F.coalesce("error_type", F.lit("")).isin("DATA_MISSING", "INTERNAL_ERROR", "CAPACITY_UNDERFLOW")
    rule = (F.coalesce("rule_reason_code", F.lit("")) != "") | ~F.coalesce("passed_school", F.lit(False))
    label = (
        F.when(ok, F.lit("ALLOCATED"))
        .when(bad_data, F.lit("DATA_ERROR"))
        .when(F.coalesce("candidate_count", F.lit(0)) <= 0, F.when(rule, F.lit("RULE_EXCLUDED")).otherwise(F.lit("NO_ELIGIBLE_MENTOR")))
        .when(~F.coalesce("passed_capacity", F.lit(False)), F.lit("NO_CAPACITY"))
        .when(rule, F.lit("RULE_EXCLUDED"))
        .otherwise(F.lit("DATA_ERROR"))
    )
    return log.withColumn("final_status", label)


def state_delta(decisions: DataFrame) -> DataFrame:
    """Capacity before / after of every success."""
    return decisions.where("allocation_status = 'success'").select(
        "student_id", "mentor_id", "capacity_before", "capacity_after", (F.col("capacity_before") - F.col("capacity_after")).alias("consumed")
    )
