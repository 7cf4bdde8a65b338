"""Chat formatting: a finite-state machine over roles, and a declarative template.

A template names the machine's start, its transitions (state, role) -> state, the states a conversation may end in,
and for each role the text around a turn and whether the loss counts on its body and on its closing mark. A valid
conversation gives segments in order, each with its text and its loss flag; an invalid one gives one row that
names its first fault and the turn.

Defined results: turns are ordered by ``turn``; rows that repeat a turn with the same role and text count once;
a turn number that comes with different rows is the fault ``duplicate_turn``; a null turn or role or an unknown role is
``bad_role``, a turn that may not follow is ``bad_order``, an end elsewhere is ``bad_end``, a null or blank text is
``empty_text``; rows with a null conv_id are left out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str
    next: dict[tuple[str, str], str]
    final: frozenset[str]
    before: dict[str, str]
    after: dict[str, str]
    loss: dict[str, bool]
    opening: str = ""
    closing: str = ""
    mark_loss: dict[str, bool] = field(default_factory=dict)


CHATML = Template(
    start="start",
    next={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    final=frozenset({"assistant"}),
    before={r: f"<|im_start|>{r}\n" for r in ("system", "user", "assistant")},
    after=dict.fromkeys(("system", "user", "assistant"), "<|im_end|>\n"),
    loss={"system": False, "user": False, "assistant": True},
    mark_loss={"assistant": True},
)

SEGMENT = "struct<role:string,text:string,loss:boolean>"


def _map(d: dict[str, object], kind: str):
    if not d:
        return F.create_map().cast(f"map<string,{kind}>")
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, segment, role, text, loss, valid, fault, fault_turn): one row a segment, or a row of a fault (segment -1)."""
    step = _map({f"{s}\x00{r}": t for (s, r), t in template.next.items()}, "string")
    roles = sorted({r for _, r in template.next})
    given = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), "role", "text").alias("x"))
    conv = given.groupBy("conv_id").agg(F.array_sort(F.collect_set("x")).alias("turns"))
    init = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("string").alias("fault"), F.lit(None).cast("long").alias("fault_turn"), F.lit(None).cast("long").alias("last"))

    def move(acc, x):
        to = step[F.concat(acc["state"], F.lit("\x00"), x["role"])]
        fault = (
            F.when(x["turn"].isNull() | x["role"].isNull() | ~x["role"].isin(roles), "bad_role")
            .when(x["turn"] == acc["last"], "duplicate_turn")
            .when(to.isNull(), "bad_order")
            .when(F.coalesce(F.regexp_replace(x["text"], r"\s", ""), F.lit("")) == "", "empty_text")
        )
        ok = F.struct(F.coalesce(to, acc["state"]).alias("state"), fault.alias("fault"), F.when(fault.isNotNull(), x["turn"]).alias("fault_turn"), x["turn"].alias("last"))
        return F.when(acc["fault"].isNotNull(), acc).otherwise(ok)

    end = F.aggregate("turns", init, move)
    conv = conv.withColumn("end", end)
    late = F.col("end.fault").isNull() & ~F.col("end.state").isin(sorted(template.final))
    conv = conv.select("conv_id", "turns", F.when(late, "bad_end").otherwise(F.col("end.fault")).alias("fault"), F.when(late, F.col("end.last")).otherwise(F.col("end.fault_turn")).alias("fault_turn"))
    before, after = _map(template.before, "string"), _map(template.after, "string")
    loss, mark = _map(template.loss, "boolean"), _map(template.mark_loss, "boolean")
    no = F.lit(False)
    part = lambda r, t, x: F.struct(r.alias("role"), t.alias("text"), x.alias("loss"))
    body = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                part(x["role"], F.coalesce(before[x["role"]], F.lit("")), no),
                part(x["role"], x["text"], F.coalesce(loss[x["role"]], no)),
                part(x["role"], F.coalesce(after[x["role"]], F.lit("")), F.coalesce(mark[x["role"]], no)),
            ),
        )
    )
    edge = lambda t: F.array(part(F.lit(None).cast("string"), F.lit(t), no))
    segments = F.filter(F.concat(edge(template.opening), body, edge(template.closing)), lambda s: s["text"] != "")
    bad = F.array(part(F.lit(None).cast("string"), F.lit(None).cast("string"), no))
    out = conv.select("conv_id", "fault", "fault_turn", F.posexplode(F.when(F.col("fault").isNull(), segments).otherwise(bad)).alias("i", "s"))
    return out.select(
        "conv_id", F.when(F.col("fault").isNull(), F.col("i")).otherwise(-1).alias("segment"), "s.role", "s.text", "s.loss", F.col("fault").isNull().alias("valid"), "fault", "fault_turn"
    )


ORACLE = r"""
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
l as (select *, lag(role, 1, 'start') over w as prev, lag(turn) over w as prev_turn, lead(turn) over w is null as is_last
      from t window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)),
f as (select *, case
        when turn is null or role is null or role not in ('system', 'user', 'assistant') then 'bad_role'
        when turn = prev_turn then 'duplicate_turn'
        when (prev, role) not in (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) then 'bad_order'
        when regexp_replace(coalesce(text, ''), '\s', '', 'g') = '' then 'empty_text'
        when is_last and role <> 'assistant' then 'bad_end' end as fault from l),
v as (select conv_id, arg_min(fault, turn) filter (where fault is not null) as fault, min(turn) filter (where fault is not null) as fault_turn from f group by 1),
n as (select f.*, row_number() over (partition by conv_id order by turn) - 1 as k from f),
s as (select n.conv_id, 3 * k + p as segment, role,
        case p when 0 then '<|im_start|>' || role || chr(10) when 1 then text else '<|im_end|>' || chr(10) end as text,
        p > 0 and role = 'assistant' as loss
      from n join v using (conv_id), (values (0), (1), (2)) q(p) where v.fault is null)
select conv_id, cast(segment as int) as segment, role, text, loss, true as valid, cast(null as varchar) as fault, cast(null as bigint) as fault_turn from s
union all select conv_id, -1, null, null, false, false, fault, fault_turn from v where fault is not null"""
