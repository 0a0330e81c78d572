"""Minimum-cost repair of conversation roles, then rendering with turn markers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
ENDS = ("start", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}
MERGE, INSERT, RELABEL = 1, 2, 3
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PLAN = "struct<cost:int,merges:int,relabels:int,inserts:int,turns:array<struct<role:string,parts:array<int>>>>"


def repair(roles: tuple) -> tuple[int, int, int, int, list[tuple[str, list[int]]]]:
    """Cheapest way to a legal sequence: (cost, merges, relabels, inserts, turns).

    Legal: an optional system turn, then user and assistant in turns, the last an assistant's.
    A turn keeps its role at no cost, takes another (3), or goes into the turn before it, whose
    role it must have or, for 3 more, take (1); an empty turn may be put anywhere (2). The
    dynamic program goes over (turns read, state of the automaton); of equally cheap ways the one
    with the least (relabels, inserts, merges) is taken, then the one found first in the order
    keep, merge, relabel, insert, states as in ``LEGAL``.
    """
    n = len(roles)
    best: dict[tuple[int, str], tuple] = {}
    back: dict[tuple[int, str], tuple] = {}
    layer = {"start": (0, 0, 0, 0)}
    for i in range(n + 1):
        # empty turns first: paths of insertions within this layer, cheapest first
        todo = sorted(layer, key=lambda s: layer[s])
        while todo:
            s = todo.pop(0)
            c = layer[s]
            for to in LEGAL[s]:
                new = (c[0] + INSERT, c[1], c[2] + 1, c[3])
                if to not in layer or new < layer[to]:
                    layer[to] = new
                    back[i, to] = (i, s, "insert", to)
                    todo.append(to)
                    todo.sort(key=lambda x: layer[x])
        best.update({(i, s): c for s, c in layer.items()})
        if i == n:
            break
        role, after = roles[i], {}

        def offer(to, cost, step, after=after, i=i):
            if to not in after or cost < after[to]:
                after[to] = cost
                back[i + 1, to] = step

        for s, c in layer.items():
            for to in LEGAL[s]:
                if to == role:
                    offer(to, c, (i, s, "keep", to))
        for s, c in layer.items():
            if s != "start":
                wrong = s != role
                offer(s, (c[0] + MERGE + RELABEL * wrong, c[1] + wrong, c[2], c[3] + 1), (i, s, "merge", s))
        for s, c in layer.items():
            for to in LEGAL[s]:
                if to != role:
                    offer(to, (c[0] + RELABEL, c[1] + 1, c[2], c[3]), (i, s, "relabel", to))
        layer = after
    end = min((s for s in ENDS if (n, s) in best), key=lambda s: best[n, s])
    cost = best[n, end]
    steps, at = [], (n, end)
    while at != (0, "start"):
        i, s, how, to = back[at]
        steps.append((i, how, to))
        at = (i, s)
    turns: list[tuple[str, list[int]]] = []
    for i, how, to in reversed(steps):
        if how == "merge":
            turns[-1][1].append(i)
        else:
            turns.append((to, [] if how == "insert" else [i]))
    return cost[0], cost[3], cost[1], cost[2], turns


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, cost, merges, relabels, inserts, roles, rendered``.

    Turns are taken in order of (turn, role, text), nulls first. Roles are trimmed, lower-cased
    and mapped by ``ALIASES``; null and unknown roles have to be relabelled. A null text is an
    empty turn, and turn markers inside a text are broken up with a space, so that a text can't
    open a turn. Merged texts are joined by a line end. Rows with a null conversation form one
    conversation; repeated rows are repeated turns; an empty table gives no rows. Other columns
    are ignored. Python only sees the roles; texts are assembled in the JVM.
    """
    named = F.lower(F.trim(F.col(role).cast("string")))
    for old, new in ALIASES.items():
        named = F.when(named == old, new).otherwise(named)
    safe = F.replace(F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))
    given = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("t"), named.alias("r"), safe.alias("x")).alias("u"))
    chats = given.groupBy("conv_id").agg(F.sort_array(F.collect_list("u")).alias("u"))

    @F.pandas_udf(PLAN)
    def plan(roles: pd.Series) -> pd.DataFrame:
        known: dict[tuple, dict] = {}
        rows = []
        for rs in roles:
            key = tuple(rs)
            if key not in known:
                cost, merges, relabels, inserts, out = repair(key)
                known[key] = {"cost": cost, "merges": merges, "relabels": relabels, "inserts": inserts, "turns": [{"role": r, "parts": p} for r, p in out]}
            rows.append(known[key])
        return pd.DataFrame(rows, columns=["cost", "merges", "relabels", "inserts", "turns"])

    planned = chats.withColumn("p", plan(F.transform("u", lambda x: x["r"])))
    body = F.transform(
        "p.turns",
        lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), F.array_join(F.transform(t["parts"], lambda i: F.element_at(F.col("u"), i + 1)["x"]), "\n"), F.lit(CLOSE + "\n")),
    )
    return planned.select(
        "conv_id", F.size("u").alias("n_turns"), "p.cost", "p.merges", "p.relabels", "p.inserts",
        F.transform("p.turns", lambda t: t["role"]).alias("roles"), F.array_join(body, "").alias("rendered"),
    )
