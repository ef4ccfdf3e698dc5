"""E-mail threads: parents from References and In-Reply-To, ancestors, nested output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import connected_components
from quillspark.plans.scratch import Scratch


def _absent(up: DataFrame, scratch: Scratch) -> DataFrame:
    """``message_idx``, ``container_id``: for messages that only name absent ones, the least of the
    absent messages that are linked by being named together. ``up`` has message_idx, ref."""
    first = up.groupBy("message_idx").agg(F.min("ref").alias("a"))
    links = up.join(first, "message_idx").select("a", F.col("ref").alias("b")).where("a <> b")
    labels = connected_components(links, scratch)
    return first.join(labels, F.col("a") == F.col("node"), "left").select("message_idx", F.coalesce("label", "a").alias("container_id"))


def parents(messages: DataFrame) -> DataFrame:
    """``message_idx``, ``message_id``, ``parent_id`` (a message of the set), ``subject`` and
    ``container_id``.

    ``messages`` has message_idx, message_id, in_reply_to, references (array, oldest first),
    subject. The parent is the nearest ancestor that is there: the last of References, with
    In-Reply-To behind the list, that names another message. Missing ancestors collapse, but for
    the one that messages without a parent have in common: it is their container. Of messages
    with one id the least message_idx stands for it.
    """
    scratch = Scratch(messages.sparkSession, "parents")
    none = F.array().cast("array<string>")
    answered = F.when(F.col("in_reply_to").isNotNull() & ~F.coalesce(F.array_contains("references", F.col("in_reply_to")), F.lit(False)), F.array("in_reply_to")).otherwise(none)
    rows = messages.select("message_idx", "message_id", "subject", F.concat(F.coalesce("references", none), answered).alias("named"))
    up = rows.select("message_idx", "message_id", F.posexplode("named").alias("place", "ref")).where("ref <> message_id")
    ids = messages.groupBy(F.col("message_id").alias("ref")).agg(F.min("message_idx").alias("ref_idx"))
    best = scratch.save(up.join(ids, "ref").groupBy("message_idx").agg(F.max_by(F.struct("ref", "ref_idx"), "place").alias("p")), "parents", narrow=True)
    absent = _absent(scratch.save(up.join(best, "message_idx", "left_anti").select("message_idx", "ref"), "absent", narrow=True), scratch)
    out = rows.join(best, "message_idx", "left").join(absent, "message_idx", "left")
    return out.select("message_idx", "message_id", F.col("p.ref").alias("parent_id"), F.col("p.ref_idx").alias("parent_idx"), "subject", "container_id")


#: What answers and forwards put before a subject.
ANSWER = r"(?i)^(\s*(re|fwd?|aw|wg|sv)(\[\d+\])?\s*:)+\s*"


def threads(tree: DataFrame, by_subject: bool = False) -> DataFrame:
    """``message_idx``, ``parent_idx``, ``root_idx`` and ``depth`` for rows of ``parents``.

    Ancestors are found by doubling: each round a message knows an ancestor twice as far up,
    so a chain of n messages takes log n joins. A cycle is cut at its least message. Messages
    without a parent that share a container, or with ``by_subject`` a subject that is not empty
    but for answer marks, are one thread, whose root is the least of them.
    """
    scratch = Scratch(tree.sparkSession, "threads")
    base = scratch.save(_acyclic(tree.select("message_idx", "parent_idx"), scratch), "parents", narrow=True)
    up = scratch.save(base.select("message_idx", F.coalesce("parent_idx", "message_idx").alias("up"), F.col("parent_idx").isNotNull().cast("long").alias("depth")), "up", narrow=True)
    while True:
        other = up.select(F.col("message_idx").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        fresh = scratch.save(up.join(other, "up").select("message_idx", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("more").alias("moved")), "up", narrow=True)
        moved = not fresh.where("moved > 0").isEmpty()
        scratch.drop(up)
        up = fresh.select("message_idx", "up", "depth")
        up._scratch_path = fresh._scratch_path
        if not moved:
            break
    found = base.join(up, "message_idx").select("message_idx", "parent_idx", F.col("up").alias("root_idx"), "depth")
    keys = [F.struct(F.lit("container").alias("kind"), F.col("container_id").alias("key"))] if "container_id" in tree.columns else []
    if by_subject:
        keys.append(F.struct(F.lit("subject").alias("kind"), F.nullif(F.lower(F.trim(F.regexp_replace("subject", ANSWER, ""))), F.lit("")).alias("key")))
    if not keys:
        return found
    roots = tree.join(base.where("parent_idx is null").select("message_idx"), "message_idx", "left_semi").select("message_idx", F.explode(F.array(*keys)).alias("k"))
    roots = scratch.save(roots.select("message_idx", "k.*").where("key is not null"), "roots", narrow=True)
    least = scratch.save(roots.groupBy("kind", "key").agg(F.min("message_idx").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "least", narrow=True)
    labels = connected_components(roots.join(least, ["kind", "key"]).select("a", F.col("message_idx").alias("b")).where("a <> b"), scratch)
    joined = found.join(labels, F.col("root_idx") == F.col("node"), "left")
    return joined.select("message_idx", "parent_idx", F.coalesce("label", "root_idx").alias("root_idx"), "depth")


def _acyclic(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Cuts cycles: without a root in its component, the least message becomes one."""
    links = edges.where("parent_idx is not null").select(F.col("message_idx").alias("a"), F.col("parent_idx").alias("b"))
    labels = connected_components(links, scratch)
    marked = edges.join(labels, F.col("message_idx") == F.col("node"), "left").select("message_idx", "parent_idx", F.coalesce("label", "message_idx").alias("part"))
    rooted = marked.groupBy("part").agg(F.max(F.col("parent_idx").isNull()).alias("rooted"))
    cut = ~F.col("rooted") & (F.col("message_idx") == F.col("part"))
    return marked.join(rooted, "part").select("message_idx", F.when(~cut, F.col("parent_idx")).alias("parent_idx"))


def nested(rows: list[dict]) -> list[dict]:
    """Trees of one page of threads, as dictionaries with id, parent, subject, children."""
    nodes = {r["message_idx"]: {"id": r["message_idx"], "parent": r.get("parent_idx"), "subject": r.get("subject"), "children": []} for r in sorted(rows, key=lambda r: r["message_idx"])}
    for n in nodes.values():
        if n["parent"] in nodes:
            nodes[n["parent"]]["children"].append(n)
    return [n for n in nodes.values() if n["parent"] not in nodes]
