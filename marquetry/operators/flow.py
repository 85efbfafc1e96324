"""Control and data flow. Facts are tables keyed by function and block; what is a fixed
point inside one function runs per function in ``applyInPandas``, whose groups are as
large as a function, and what crosses functions is joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.operators.graph import reach
from marquetry.runtime import cut


def lattice_meet(values: DataFrame, keys: list[str]) -> DataFrame:
    """Meet of ``(keys, tag, val)``: top is neutral, equal constants stay, else bottom."""
    const = F.col("tag") == "const"
    agg = values.groupBy(*keys).agg(
        F.min(F.when(const, F.col("val"))).alias("lo"), F.max(F.when(const, F.col("val"))).alias("hi"), F.bool_or(F.col("tag") == "bottom").alias("bad")
    )
    tag = F.when(F.col("bad") | (F.col("lo") != F.col("hi")), "bottom").when(F.col("lo").isNotNull(), "const").otherwise("top")
    return agg.select(*keys, tag.alias("tag"), F.when(tag == "const", F.col("lo")).alias("val"))


def dead_stores(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``(func, var, pos, reason)``: never read after, or overwritten before a read.

    Reads up to the position of the next store keep a store (``x = x + 1`` reads it). One
    window over stores and reads together replaces range joins.
    """
    both = defs.select("func", "var", "pos", F.lit(True).alias("d")).unionByName(uses.select("func", "var", "pos", F.lit(False).alias("d")))
    w = Window.partitionBy("func", "var").orderBy("pos")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    rows = both.select(
        "*", F.first(F.when(F.col("d"), F.col("pos")), ignorenulls=True).over(after).alias("next_def"),
        F.first(F.when(~F.col("d"), F.col("pos")), ignorenulls=True).over(after).alias("next_use"),
    ).filter("d")
    reason = F.when(F.col("next_use").isNull(), "never_read").when(F.col("next_def").isNotNull() & (F.col("next_use") > F.col("next_def")), "overwritten")
    return rows.select("func", "var", "pos", reason.alias("reason")).filter("reason is not null")


def filter_dead_stores(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Without captured, loop-control, undeclared and ``_`` names. ``facts(func, var, fact)``."""
    out = facts.filter(F.col("fact").isin("captured", "loop_control", "not_local")).select("func", "var").distinct()
    return found.filter(~F.col("var").startswith("_")).join(out, ["func", "var"], "left_anti")


def _successors(edges: pd.DataFrame) -> tuple[dict, dict]:
    succ, pred = {}, {}
    for a, b in zip(edges.src, edges.dst, strict=True):
        succ.setdefault(a, []).append(b)
        pred.setdefault(b, []).append(a)
    return succ, pred


def _dominators(blocks: list, entry, succ: dict, pred: dict) -> dict:
    """Immediate dominators over a reverse post-order; unreachable blocks have none."""
    order, seen, stack = [], {entry}, [(entry, iter(succ.get(entry, ())))]
    while stack:
        v, it = stack[-1]
        for w in it:
            if w not in seen:
                seen.add(w)
                stack.append((w, iter(succ.get(w, ()))))
                break
        else:
            order.append(v)
            stack.pop()
    order.reverse()
    place, idom, changed = {v: i for i, v in enumerate(order)}, {entry: entry}, True
    while changed:
        changed = False
        for v in order[1:]:
            new = None
            for p in pred.get(v, ()):
                if p in idom:
                    if new is None:
                        new = p
                    else:
                        a, b = p, new
                        while a != b:
                            while place[a] > place[b]:
                                a = idom[a]
                            while place[b] > place[a]:
                                b = idom[b]
                        new = a
            if new is not None and idom.get(v) != new:
                idom[v], changed = new, True
    return {v: d for v, d in idom.items() if v != entry}


def dominators(blocks: DataFrame, edges: DataFrame, *, post: bool = False) -> DataFrame:
    """``(func, block, idom)``; with ``post`` over the reversed graph from a joint exit
    (block -1). The closest post-dominator is returned."""

    def run(key, b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        succ, pred = _successors(e)
        entry = b.loc[b.is_entry, "block"].min() if b.is_entry.any() else (b.block.min() if len(b) else None)
        if post:
            exits = [x for x in b.block if not succ.get(x)]
            succ, pred = pred, succ
            entry = -1
            succ[-1] = exits
            for x in exits:
                pred.setdefault(x, []).append(-1)
        found = _dominators(list(b.block), entry, succ, pred) if entry is not None else {}
        return pd.DataFrame([(key[0], *r) for r in found.items()], columns=["func", "block", "idom"])

    return blocks.groupBy("func").cogroup(edges.groupBy("func")).applyInPandas(run, "func string, block int, idom int")


def control_dependence(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``(func, src, dst)``: dst runs or not as src branches. From each successor the
    post-dominator chain is walked up to the branch's own post-dominator."""
    ipdom = dominators(blocks, edges, post=True)

    def run(key, e: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        up = dict(zip(d.block, d.idom, strict=True))
        fan = e.groupby("src").dst.nunique() if len(e) else {}
        out = set()
        for a, b in zip(e.src, e.dst, strict=True):
            if fan[a] < 2:
                continue
            at, steps = b, 0
            while at != up.get(a) and at != -1 and at is not None and steps <= len(up) + 1:
                out.add((a, at))
                at, steps = up.get(at), steps + 1
        return pd.DataFrame([(key[0], *r) for r in sorted(out)], columns=["func", "src", "dst"])

    return edges.groupBy("func").cogroup(ipdom.groupBy("func")).applyInPandas(run, "func string, src int, dst int")


def reaching_definitions(blocks: DataFrame, edges: DataFrame, defs: DataFrame) -> DataFrame:
    """``(func, block, def_block, def_stmt, var)``: definitions that reach a block's start.

    Definitions are named by their place, never by a list position.
    """
    last = defs.groupBy("func", "block", "var").agg(F.max("stmt").alias("stmt"))

    def run(key, e: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        succ, pred = _successors(e)
        gen = {}
        for b, s, v in zip(d.block, d.stmt, d["var"], strict=True):
            gen.setdefault(b, set()).add((b, s, v))
        blocks_ = sorted({*e.src, *e.dst, *d.block})
        into = {b: set() for b in blocks_}
        out = {b: set(gen.get(b, ())) for b in blocks_}
        work = list(blocks_)
        while work:
            b = work.pop()
            into[b] = set().union(*[out[p] for p in pred.get(b, ())])
            killed = {v for _, _, v in gen.get(b, ())}
            new = gen.get(b, set()) | {x for x in into[b] if x[2] not in killed}
            if new != out[b]:
                out[b] = new
                work += succ.get(b, [])
        rows = [(key[0], b, *x) for b in blocks_ for x in sorted(into[b])]
        return pd.DataFrame(rows, columns=["func", "block", "def_block", "def_stmt", "var"])

    return edges.groupBy("func").cogroup(last.groupBy("func")).applyInPandas(run, "func string, block int, def_block int, def_stmt int, var string")


def liveness(blocks: DataFrame, edges: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``(func, block, var)``: variables live at a block's start. A use after a definition
    of the same block does not count."""
    first = defs.groupBy("func", "block", "var").agg(F.min("stmt").alias("at"))
    exposed = uses.join(first, ["func", "block", "var"], "left").filter("at is null or stmt <= at").select("func", "block", "var", F.lit(0).alias("d"))
    facts = first.select("func", "block", "var", F.lit(1).alias("d")).union(exposed).distinct()

    def run(key, e: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        succ, pred = _successors(e)
        use, kill = {}, {}
        for b, v, d in zip(f.block, f["var"], f.d, strict=True):
            (kill if d else use).setdefault(b, set()).add(v)
        names = sorted({*e.src, *e.dst, *f.block})
        live = {b: set(use.get(b, ())) for b in names}
        work = list(names)
        while work:
            b = work.pop()
            after = set().union(*[live[s] for s in succ.get(b, ())])
            new = use.get(b, set()) | (after - kill.get(b, set()))
            if new != live[b]:
                live[b] = new
                work += pred.get(b, [])
        return pd.DataFrame([(key[0], b, v) for b in names for v in sorted(live[b])], columns=["func", "block", "var"])

    return edges.groupBy("func").cogroup(facts.groupBy("func")).applyInPandas(run, "func string, block int, var string")


def data_dependence(reaching: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``(func, src, dst, var)`` from definitions to the blocks that use them."""
    u = uses.select("func", "block", "var", "stmt")
    earlier = defs.select("func", "block", "var", F.col("stmt").alias("s"))
    local = u.join(earlier, ["func", "block", "var"]).filter("s < stmt").select("func", F.col("block").alias("src"), F.col("block").alias("dst"), "var")
    exposed = u.join(earlier, ["func", "block", "var"], "left").groupBy("func", "block", "var", "stmt").agg(F.coalesce(F.bool_or(F.col("s") < F.col("stmt")), F.lit(False)).alias("covered")).filter("not covered")
    global_ = exposed.join(reaching, ["func", "block", "var"]).select("func", F.col("def_block").alias("src"), F.col("block").alias("dst"), "var")
    return local.union(global_).distinct()


def def_use_chains(reaching: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Per definition the blocks that use it, in order; none for dead ones."""
    links = data_dependence(reaching, defs, uses).groupBy("func", F.col("src").alias("block"), "var").agg(F.sort_array(F.collect_set("dst")).alias("used_in"))
    return defs.select("func", "block", "var").distinct().join(links, ["func", "block", "var"], "left").select("func", "block", "var", F.coalesce("used_in", F.array().cast("array<int>")).alias("used_in"))


def program_dependence(control: DataFrame, data: DataFrame) -> DataFrame:
    return control.select("func", "src", "dst", F.lit("control").alias("kind"), F.lit(None).cast("string").alias("var")).unionByName(
        data.select("func", "src", "dst", F.lit("data").alias("kind"), "var")
    )


def block_id(func, block):
    return F.xxhash64(func, block)


def slice_blocks(pdg: DataFrame, criteria: DataFrame, *, backward: bool = True, var: str | None = None) -> DataFrame:
    """``(func, block)`` in the slice of ``criteria(func, block)``."""
    e = pdg if var is None else pdg.filter((F.col("kind") == "control") | (F.col("var") == var))
    e, criteria = cut(e.select("func", "src", "dst")), cut(criteria.select("func", "block"))  # walked and named: made once
    a, b = block_id(F.col("func"), F.col("src")), block_id(F.col("func"), F.col("dst"))
    edges = e.select((b if backward else a).alias("src"), (a if backward else b).alias("dst"))
    names = e.select("func", F.col("src").alias("block")).union(e.select("func", "dst")).union(criteria.select("func", "block")).distinct().withColumn("id", block_id(F.col("func"), F.col("block")))
    found = reach(edges, criteria.select(block_id(F.col("func"), F.col("block")).alias("id"))).select("id").distinct()
    return names.join(found, "id", "left_semi").select("func", "block")


def dead_blocks(blocks: DataFrame, pdg: DataFrame) -> DataFrame:
    """Blocks in no backward slice of an exit; entries and exits live."""
    exits = blocks.filter("is_exit").select("func", "block")
    live = slice_blocks(pdg, exits).union(blocks.filter("is_entry or is_exit").select("func", "block")).distinct()
    return blocks.select("func", "block").join(live, ["func", "block"], "left_anti")


def constant_propagation(edges: DataFrame, assigns: DataFrame) -> DataFrame:
    """``(func, block, var, tag, val)`` at each block's end. ``assigns(func, block, stmt, var,
    expr)``; an expression is evaluated over what is known there."""
    from marquetry.functions.evaluate import evaluate

    def run(key, e: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        succ, pred = _successors(e)
        code = {}
        for b, _, v, x in sorted(zip(a.block, a.stmt, a["var"], a.expr, strict=True), key=lambda r: (r[0], r[1])):
            code.setdefault(b, []).append((v, x))
        names = sorted({*e.src, *e.dst, *a.block})
        out = {b: None for b in names}
        # Each variable of a block only falls from unknown to constant to bottom, so this ends.
        low = {b: {} for b in names}
        work = list(reversed(names))
        while work:
            b = work.pop()
            if pred.get(b) and all(out[p] is None for p in pred[b]):
                continue  # comes back when one of them is known
            env = {}
            for p in pred.get(b, ()):
                for v, x in (out[p] or {}).items():
                    env[v] = x if v not in env or env[v] == x else ("bottom", None)
            for v, x in code.get(b, ()):
                env[v] = evaluate(x, env)
            for v, x in env.items():  # a value that changed once stays bottom
                had = low[b].get(v)
                if had is not None and had != x:
                    env[v] = ("bottom", None)
                low[b][v] = env[v]
            if env != out[b]:
                out[b] = env
                work += succ.get(b, [])
        rows = [(key[0], b, v, t, None if t != "const" else repr(x)) for b in names for v, (t, x) in sorted((out[b] or {}).items())]
        return pd.DataFrame(rows, columns=["func", "block", "var", "tag", "val"])

    return edges.groupBy("func").cogroup(assigns.groupBy("func")).applyInPandas(run, "func string, block int, var string, tag string, val string")


def interprocedural_constants(calls: DataFrame, known: DataFrame, *, rounds: int = 3) -> DataFrame:
    """Parameters that every call gives one constant: ``(func, param, tag, val)``.

    ``calls(caller, callee, param, tag, val, var)``: a constant argument, or a variable
    (``tag = 'var'``) looked up among the caller's ``known(func, param, tag, val)``.
    """
    now = cut(known.select("func", "param", "tag", "val"))
    for _ in range(rounds):
        k = now.select(F.col("func").alias("caller"), F.col("param").alias("var"), F.col("tag").alias("kt"), F.col("val").alias("kv"))
        args = calls.join(k, ["caller", "var"], "left").select(
            F.col("callee").alias("func"), "param", F.when(F.col("tag") == "var", F.coalesce("kt", F.lit("bottom"))).otherwise(F.col("tag")).alias("tag"),
            F.when(F.col("tag") == "var", F.col("kv")).otherwise(F.col("val")).alias("val"),
        )
        met = lattice_meet(args, ["func", "param"])
        now = cut(met.unionByName(known.join(met, ["func", "param"], "left_anti")))
    return now


def dead_branches(blocks: DataFrame, env: DataFrame, conditions: DataFrame) -> DataFrame:
    """``(func, block, branch)`` never taken: the condition variable is a known constant."""
    false = F.col("val").isin("0", "False", "''", "None", "0.0")
    known = conditions.join(env.filter("tag = 'const'"), ["func", "block", "var"])
    return known.select("func", "block", F.when(false, "true").otherwise("false").alias("branch"))


def system_dependence(pdg: DataFrame, calls: DataFrame) -> DataFrame:
    """Dependence over functions: ``(src, dst, kind)`` on ``func:block`` names.

    ``calls(caller, block, callee, entry, exit)``. A call site is two nodes: ``func:block``,
    where arguments are given, and ``func:block:ret``, where the result comes back and which
    what depends on the call hangs on. They are joined by call, param-in and param-out
    edges, and by a summary edge where the callee's exit depends on its entry.
    """
    name = lambda f, b: F.concat_ws(":", f, b.cast("string"))
    sites = calls.select(name(F.col("caller"), F.col("block")).alias("site")).distinct()
    inside = pdg.select(name(F.col("func"), F.col("src")).alias("src"), name(F.col("func"), F.col("dst")).alias("dst"), "kind")
    after = inside.join(sites, inside.src == sites.site, "left").select(
        F.when(F.col("site").isNotNull() & (F.col("kind") == "data"), F.concat("src", F.lit(":ret"))).otherwise(F.col("src")).alias("src"), "dst", "kind"
    )
    site = name(F.col("caller"), F.col("block"))
    into, out = name(F.col("callee"), F.col("entry")), name(F.col("callee"), F.col("exit"))
    back = F.concat(site, F.lit(":ret"))
    call = calls.select(site.alias("src"), into.alias("dst"), F.lit("call").alias("kind"))
    give = calls.select(site.alias("src"), into.alias("dst"), F.lit("param_in").alias("kind"))
    take = calls.select(out.alias("src"), back.alias("dst"), F.lit("param_out").alias("kind"))
    through = _exits_on_entries(pdg, calls)
    short = calls.join(through, ["callee", "entry", "exit"]).select(site.alias("src"), back.alias("dst"), F.lit("summary").alias("kind"))
    return after.unionByName(call).unionByName(give).unionByName(take).unionByName(short).distinct()


def _exits_on_entries(pdg: DataFrame, calls: DataFrame) -> DataFrame:
    """``(callee, entry, exit)`` of callees whose exit depends on their entry. Each entry is
    a seed of its own kind, so all callees are walked in one pass."""
    ends = cut(calls.select("callee", "entry", "exit").distinct())
    a, b = block_id(F.col("func"), F.col("src")), block_id(F.col("func"), F.col("dst"))
    seeds = ends.select(block_id(F.col("callee"), F.col("entry")).alias("id"), F.col("callee").alias("kind"))
    found = reach(pdg.select(a.alias("src"), b.alias("dst")), seeds).select("id", F.col("kind").alias("callee"))
    return ends.withColumn("id", block_id(F.col("callee"), F.col("exit"))).join(found, ["id", "callee"], "left_semi").select("callee", "entry", "exit")


def sdg_slice(sdg: DataFrame, criteria: DataFrame, *, backward: bool = True) -> DataFrame:
    """Two-phase slice of ``criteria(node)``. Backward: first to callers without entering
    callees, then into callees without leaving them; forward: the other way round."""
    first, second = (("param_out",), ("call", "param_in")) if backward else (("call", "param_in"), ("param_out",))

    def walk(without: tuple[str, ...], start: DataFrame) -> DataFrame:
        edges = sdg.filter(~F.col("kind").isin(*without))
        a, b = F.xxhash64("src"), F.xxhash64("dst")
        ids = edges.select((b if backward else a).alias("src"), (a if backward else b).alias("dst"))
        return reach(ids, start.select(F.xxhash64("node").alias("id"))).select("id").distinct()

    names = sdg.select(F.col("src").alias("node")).union(sdg.select("dst")).union(criteria.select("node")).distinct().withColumn("id", F.xxhash64("node"))
    one = cut(names.join(walk(first, criteria), "id", "left_semi").select("node"))
    two = walk(second, one)
    return names.join(two, "id", "left_semi").select("node").union(one).distinct()


def sdg_dead(nodes: DataFrame, reached: DataFrame, sdg: DataFrame, live: DataFrame) -> DataFrame:
    """Functions that calls reach but whose blocks no slice of ``live(node)`` needs.

    ``nodes(id, func)``. Functions without a block in the dependence graph stay: nothing is
    known of them.
    """
    func = F.regexp_extract("node", r"^(.*?):[0-9]+(?::ret)?$", 1)
    covered = sdg.select(F.col("src").alias("node")).union(sdg.select("dst")).select(func.alias("func")).distinct()
    needed = sdg_slice(sdg, live).select(func.alias("func")).distinct()
    dead = covered.join(needed, "func", "left_anti")
    return nodes.join(reached.select("id").distinct(), "id", "left_semi").join(dead, "func", "left_semi").select("id", "func")


def dead_call_branches(parameters: DataFrame, conditions: DataFrame) -> DataFrame:
    """``(func, block, branch)`` never taken as every call gives a parameter one value.

    ``parameters(func, param, tag, val)`` of ``interprocedural_constants``;
    ``conditions(func, block, var)``.
    """
    false = F.col("val").isin("0", "False", "''", "None", "0.0")
    known = conditions.join(parameters.filter("tag = 'const'").withColumnRenamed("param", "var"), ["func", "var"])
    return known.select("func", "block", F.when(false, "true").otherwise("false").alias("branch"))


def skeleton_cfg(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and edges of an entry that leads to an exit, for functions whose body is not
    read; of functions with one name the first by place stands for all."""
    first = functions.groupBy("name").agg(F.min(F.struct("file", "line_start")).alias("x")).select(F.col("name").alias("func"))
    rows = F.array(
        F.struct(F.lit(0).alias("block"), F.lit("entry").alias("label"), F.lit(True).alias("is_entry"), F.lit(False).alias("is_exit")),
        F.struct(F.lit(1).alias("block"), F.lit("exit").alias("label"), F.lit(False).alias("is_entry"), F.lit(True).alias("is_exit")),
    )
    blocks = first.select("func", F.explode(rows).alias("b")).select("func", "b.*")
    return blocks, first.select("func", F.lit(0).alias("src"), F.lit(1).alias("dst"), F.lit("next").alias("kind"))


def textual_flow(functions: DataFrame) -> DataFrame:
    """``(file, name, variable, line_no, kind)``: where a function's lines write and read
    its variables, from line patterns alone. ``functions(file, name, line_start, source)``."""
    rows = functions.select("file", "name", "line_start", F.posexplode(F.split("source", "\n")).alias("p", "line"))
    code = F.regexp_replace(F.regexp_replace("line", r"\"[^\"]*\"|'[^']*'", "''"), r"(?:#|//).*$", "")
    target = F.regexp_extract(code, r"^\s*(?:(?:let|const|var|mut|int|auto)\s+)*([A-Za-z_]\w*)\s*(?::[^=]+)?(?:[-+*/|&]|:)?=(?!=)", 1)
    placed = rows.select("file", "name", (F.col("line_start") + F.col("p")).alias("line_no"), code.alias("code"), target.alias("target")).filter("code <> ''")
    defs = placed.filter("target <> ''").select("file", "name", F.col("target").alias("variable"), "line_no", F.lit("def").alias("kind"))
    right = F.when((F.col("target") != "") & ~F.col("code").rlike(r"[-+*/|&]=(?!=)"), F.regexp_replace("code", r"^[^=]*=", "")).otherwise(F.col("code"))
    words = placed.select("file", "name", "line_no", F.explode(F.array_distinct(F.regexp_extract_all(right, F.lit(r"(?<![\w.])([A-Za-z_]\w*)"), F.lit(1)))).alias("variable"))
    uses = words.join(defs.select("file", "name", "variable").distinct(), ["file", "name", "variable"], "left_semi")
    return defs.unionByName(uses.select("file", "name", "variable", "line_no", F.lit("use").alias("kind"))).distinct()


def dead_store_facts(facts: DataFrame) -> DataFrame:
    """``(func, var, fact)`` for ``filter_dead_stores`` from extracted facts: names that a
    function inside reads (captured), that loops write as their control, and that no
    definition of the function declares."""
    func = F.concat_ws(":", "file", "owner")
    defs = facts.filter("tag = 'def'").select(func.alias("func"), "file", "owner", F.col("name").alias("var"), F.col("line").alias("block")).distinct()
    uses = facts.filter("tag = 'use'").select("file", F.col("owner").alias("user"), F.col("name").alias("var")).distinct()
    captured = defs.join(uses, ["file", "var"]).filter(F.col("user").startswith(F.concat("owner", F.lit(".")))).select("func", "var", F.lit("captured").alias("fact"))
    loops = facts.filter("tag = 'cfg_block' and detail = 'loop'").select(func.alias("func"), F.col("line").alias("block"))
    control = defs.join(loops, ["func", "block"]).select("func", "var", F.lit("loop_control").alias("fact"))
    used = facts.filter("tag = 'use'").select(func.alias("func"), F.col("name").alias("var"))
    foreign = used.join(defs.select("func", "var"), ["func", "var"], "left_anti").select("func", "var", F.lit("not_local").alias("fact"))
    return captured.unionByName(control).unionByName(foreign).distinct()
