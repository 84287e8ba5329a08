"""Daily assignment under capacity, eligibility and transfers."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.operators.ranking import Key, Running, null_safe_key, with_positions, with_running
from leadloom.session import cut_lineage

SITE = ["empresa_id", "punto_venta_id"]


def exclusion_reason(now: Column) -> Column:
    """Why a lead takes no part in the automatic assignment; null when it does."""
    has_state = F.col("estado").isNotNull()
    return (
        F.when(F.col("cola").startswith("revision"), "revision")
        .when(F.coalesce("punto_venta_id", F.lit("")) == "", "sin_sede_verificable")
        .when(has_state & ((F.col("estado") != "abierto") | F.col("requiere_revision")),
              "estado_no_elegible")
        .when(has_state & (F.col("proxima_accion_en") > now), "seguimiento_futuro"))


def attention_order(now: Column) -> list[Key]:
    """Overdue follow-ups first by due date, then score, oldest date, id."""
    due = F.when(F.col("proxima_accion_en") <= now, F.col("proxima_accion_en"))
    return [
        Key(due, nulls_last=True), Key("score", desc=True, nulls_last=True),
        Key("fecha", nulls_last=True), Key("lead_consolidado_id"),
    ]


def attention_levels(order: list[Key]) -> tuple[list[Key], list[Key]]:
    """Bucket prefixes of ``attention_order``: by due hour, and the many leads without a due date
    by score and month; then by the order keys themselves and the start of the id."""
    due, score, date, lead = (Key(k.expr, k.desc, k.nulls_last) for k in order)
    when = due.expr if not isinstance(due.expr, str) else F.col(due.expr)
    free = when.isNull()
    coarse = [
        Key(F.date_trunc("hour", when), nulls_last=True),
        Key(F.when(free, F.col(score.expr)), desc=True, nulls_last=True),
        Key(F.when(free, F.trunc(date.expr, "month")), nulls_last=True),
    ]
    return coarse, [due, score, date, Key(F.substring(lead.expr, 1, 6))]


def daily_assignment(candidates: DataFrame, members: DataFrame, already: DataFrame, now: Column
                     ) -> tuple[DataFrame, DataFrame]:
    """Assign leads to advisors of their site within the remaining capacity of the day.

    ``candidates``: empresa_id, lead_consolidado_id, cola, score, fecha, punto_venta_id, estado,
    requiere_revision, proxima_accion_en, responsable. ``members`` (active advisors):
    membresia_id, empresa_id, asesor_id, punto_venta_id, capacidad, carga, ultima_posicion.
    ``already``: lead ids assigned today.

    Returns ``(assignments, pending)``. The choice is greedy in attention order, but only as many
    leads as there are free places can ever be taken: of the leads without an owner at most the
    free places of the site, of an owner's leads at most that advisor's free places. Everything
    after that is pending by definition, so the sequential step sees a number of rows bounded by
    the staff capacity and never a whole site.
    """
    open_leads = candidates.join(
        already.select("empresa_id", "lead_consolidado_id"),
        ["empresa_id", "lead_consolidado_id"], "left_anti")
    judged = open_leads.withColumn("motivo", exclusion_reason(now))
    excluded = judged.where(F.col("motivo").isNotNull())
    order = attention_order(now)
    # a flat order key survives the joins below
    ready = judged.where(F.col("motivo").isNull()).withColumn("_due", order[0].expr)
    order = [Key("_due", nulls_last=True), *order[1:]]
    coarse, fine = attention_levels(order)

    places = members.groupBy("empresa_id", "punto_venta_id", "asesor_id").agg(
        F.greatest(F.max(F.coalesce("capacidad", F.lit(0))) - F.max("carga"), F.lit(0))
        .alias("_free"))
    per_site = places.groupBy(*SITE).agg(F.sum("_free").alias("_limit"))
    per_owner = members.select(
        F.col("membresia_id").alias("responsable"), "empresa_id", "punto_venta_id", "asesor_id"
    ).join(places, ["empresa_id", "punto_venta_id", "asesor_id"]).select(
        "responsable", *SITE, F.col("_free").alias("_limit"))

    free = with_positions(
        ready.where(F.col("responsable").isNull()), SITE, order, coarse, fine, "_pos"
    ).join(per_site, SITE, "left")
    owned = with_positions(
        ready.where(F.col("responsable").isNotNull()), [*SITE, "responsable"], order, coarse, fine,
        "_pos",
    ).join(per_owner, [*SITE, "responsable"], "left")
    ranked = free.unionByName(owned, allowMissingColumns=True)
    reachable = F.col("_pos") <= F.coalesce("_limit", F.lit(0))
    short = ranked.where(reachable)
    rest = ranked.where(~reachable).withColumn("motivo", F.lit("sin_cupo_o_asesor"))

    picked = (
        short.select("empresa_id", "punto_venta_id", "lead_consolidado_id", "responsable", "_due",
                     F.col("score").cast("double").alias("score"), "fecha")
        .groupBy(*SITE)
        .cogroup(members.groupBy(*SITE))
        .applyInPandas(_fill_site, (
            "empresa_id string, punto_venta_id string, lead_consolidado_id string, "
            "membresia_id long, posicion_inicial long"))
    )
    assigned = picked.where(F.col("membresia_id").isNotNull()).withColumn(
        "motivo", F.lit(V.ASSIGNMENT_REASON))
    refused = picked.where(F.col("membresia_id").isNull()).select(
        "empresa_id", "lead_consolidado_id", F.lit("sin_cupo_o_asesor").alias("motivo"))
    columns = ["empresa_id", "lead_consolidado_id", "motivo"]
    pending = excluded.select(*columns).unionByName(rest.select(*columns)).unionByName(refused)
    return assigned, pending


def _fill_site(leads: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Greedy filling of one site; both frames are bounded by its staff capacity.

    Members wait in a heap by room and number. An entry is good while it shows its advisor's room;
    members of one advisor share it, so each change enters all of them anew.
    """
    out = []
    if len(leads):
        staff = [tuple(m) for m in members[["membresia_id", "asesor_id", "capacidad", "carga", "ultima_posicion"]].itertuples(index=False)]
        room, last, advisor, mates = {}, {}, {}, {}
        for m, a, capacity, load, position in sorted(staff):
            advisor[m], last[m] = a, position
            mates.setdefault(a, []).append(m)
            room[a] = (0 if pd.isna(capacity) else capacity) - load
        waiting = [(-room[a], m) for m, a in advisor.items()]
        heapq.heapify(waiting)
        ordered = leads.sort_values(
            ["_due", "score", "fecha", "lead_consolidado_id"],
            ascending=[True, False, True, True], na_position="last")
        for lead in ordered.itertuples(index=False):
            if pd.isna(lead.responsable):
                while waiting and -waiting[0][0] != room[advisor[waiting[0][1]]]:
                    heapq.heappop(waiting)
                best = waiting[0][1] if waiting and waiting[0][0] < 0 else None
            else:
                best = lead.responsable if room.get(advisor.get(lead.responsable), 0) > 0 else None
            position = None
            if best is not None:
                best = int(best)
                room[advisor[best]] -= 1
                for m in mates[advisor[best]]:
                    heapq.heappush(waiting, (-room[advisor[best]], m))
                last[best] += 1
                position = last[best]
            out.append([lead.empresa_id, lead.punto_venta_id, lead.lead_consolidado_id, best, position])
    frame = pd.DataFrame(out, columns=[
        "empresa_id", "punto_venta_id", "lead_consolidado_id", "membresia_id",
        "posicion_inicial"])
    return frame.astype({"membresia_id": "Int64", "posicion_inicial": "Int64"})


def pending_by_reason(pending: DataFrame) -> DataFrame:
    return pending.groupBy("empresa_id", "motivo").agg(F.count(F.lit(1)).alias("leads"))


#: Requests between two summary rows of a running value.
LEDGER_CHUNK = 4096


def _asked(requests: DataFrame, states: DataFrame, members: DataFrame, assignments: DataFrame) -> DataFrame:
    """Requests with all that no other request can change, one row per request."""
    lead = ["empresa_id", "lead_consolidado_id"]
    target = members.select(
        F.col("membresia_id").alias("destino"), F.col("empresa_id").alias("_m_emp"), "rol",
        "activa", F.col("asesor_id").alias("_to"), F.col("punto_venta_id").alias("_m_site"))
    holder = members.select(
        F.col("membresia_id").alias("_a_member"), F.col("asesor_id").alias("_a_asesor"))
    today = assignments.select(*lead, F.col("estado").alias("_a_estado"),
                               F.col("membresia_id").alias("_a_member")).join(holder, "_a_member", "left")
    j = (
        requests.select("solicitud_id", *lead, "destino")
        .join(states.select(*lead, "responsable", "punto_venta_id"), lead, "left")
        .join(target, "destino", "left").join(today, lead, "left"))
    valid_member = (F.col("_m_emp") == F.col("empresa_id")) & (F.col("rol") == "asesor") & F.col("activa")
    late = (  # reasons that stand behind "sin_cambio"
        F.when(F.col("_to").isNull(), "sin_asesor_operativo")
        .when(F.coalesce("punto_venta_id", F.lit("")) == "", "sin_sede_verificable")
        .when(~F.coalesce(F.col("_m_site") == F.col("punto_venta_id"), F.lit(False)), "sede_distinta"))
    return j.withColumns({
        "_invalid": ~F.coalesce(valid_member, F.lit(False)), "_late": late,
        "_open": F.col("_a_member").isNotNull() & (F.coalesce("_a_estado", F.lit("")) != "completada"),
        "_lead": null_safe_key(lead),
    }).drop("rol", "activa", "_m_emp", "_m_site", "_a_estado", "punto_venta_id")


def _judged(asked: DataFrame) -> DataFrame:
    """Owner and holder of each request's lead as the requests granted before left them, and what follows."""
    chunk = F.floor(F.col("solicitud_id") / LEDGER_CHUNK)
    given = F.when(F.col("_granted"), F.struct(F.col("destino").alias("m"), F.col("_to").alias("a")))
    x = with_running(asked, ["_lead"], ["solicitud_id"], chunk, {"_before": Running("last", given)}, 1)
    owner = F.coalesce("_before.m", "responsable")
    x = x.withColumns({
        "_owner": owner, "_holder": F.coalesce("_before.m", "_a_member"),
        "_from": F.when(F.col("_before").isNotNull(), F.col("_before.a")).otherwise(F.col("_a_asesor"))})
    why = (F.when(F.col("_invalid"), "responsable_invalido")
           .when(F.col("_owner") == F.col("destino"), "sin_cambio").otherwise(F.col("_late")))
    moves = why.isNull() & F.col("_open") & (F.col("_holder") != F.col("destino"))
    return x.withColumns({"_why": why, "_moves": F.coalesce(moves, F.lit(False))}).drop("_before")


def _ledger(judged: DataFrame, room: DataFrame) -> DataFrame:
    """solicitud_id, _fits: whether a move finds a free place, given the departures that were granted.

    Per advisor, arrivals that find no place are turned away. With I arrivals and O departures so far,
    ``load + I - O - capacity`` (but never more than I) is the least number that must have been turned
    away by then, and the running maximum of that is the number that was. So an arrival is turned
    away exactly where the maximum rises: no step by step count is needed.
    """
    arrivals = judged.where("_moves").select("empresa_id", F.col("_to").alias("asesor_id"), "solicitud_id", F.lit(1).alias("_in"))
    departures = judged.where(F.col("_moves") & F.col("_granted") & F.col("_from").isNotNull()).select(
        "empresa_id", F.col("_from").alias("asesor_id"), "solicitud_id", F.lit(0).alias("_in"))
    advisor = ["empresa_id", "asesor_id"]
    chunk = F.floor(F.col("solicitud_id") / LEDGER_CHUNK)
    events = arrivals.unionByName(departures).withColumn("_after", 1 - F.col("_in"))
    order = ["solicitud_id", "_after"]  # a request arrives before it leaves the former advisor
    counted = with_running(events, advisor, order, chunk, {
        "_i": Running("sum", F.col("_in"), True), "_o": Running("sum", 1 - F.col("_in"), True)}, 1)
    arrived = counted.where("_in = 1").join(room, advisor)
    over = F.least(F.col("_load") + F.col("_i") - F.col("_o") - F.col("_places"), F.col("_i"))
    arrived = arrived.withColumn("_over", F.greatest(over, F.lit(0)))
    turned = with_running(arrived, advisor, order, chunk, {
        "_now": Running("max", F.col("_over"), True), "_past": Running("max", F.col("_over"))}, 1)
    return turned.select("solicitud_id", (F.col("_now") == F.coalesce("_past", F.lit(0))).alias("_fits"))


#: Companies with more requests than this are settled in rounds, spread over many tasks.
IN_ORDER = 50_000
_OUTCOME = "solicitud_id bigint, _owner bigint, _holder bigint, _why string, _moves boolean, _granted boolean"


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One company after the other: its free places first, then its requests in order."""
    company, load, places, holds, owns = None, {}, {}, {}, {}
    for frame in frames:
        out = []
        for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
            if row.empresa != company:
                company, load, places, holds, owns = row.empresa, {}, {}, {}, {}
            if row.solicitud_id is None:
                load[row.to_], places[row.to_] = row.load, row.places
                continue
            lead = row.lead
            owner = owns.get(lead, row.responsable)
            holder, leaves = holds.get(lead, (row.member, row.asesor))
            why = "responsable_invalido" if row.invalid else "sin_cambio" if owner == row.destino else row.late
            moves = why is None and row.open and holder != row.destino
            granted = why is None and (not moves or load.get(row.to_, 0) < places.get(row.to_, 0))
            if granted:
                owns[lead], holds[lead] = row.destino, (row.destino, row.to_)
                if moves:
                    load[row.to_] = load.get(row.to_, 0) + 1
                    if leaves is not None:
                        load[leaves] = load.get(leaves, 0) - 1
            out.append((row.solicitud_id, owner, holder, why, moves, granted))
        yield pd.DataFrame(out, columns=["solicitud_id", "_owner", "_holder", "_why", "_moves", "_granted"]).astype(
            {"solicitud_id": "int64", "_owner": "Int64", "_holder": "Int64", "_moves": bool, "_granted": bool})


def _in_order(asked: DataFrame, room: DataFrame) -> DataFrame:
    """Outcomes of companies with a bounded number of requests, each passed through in order."""
    nothing = {c: F.lit(None).cast(t) for c, t in (
        ("lead", "string"), ("destino", "bigint"), ("invalid", "boolean"), ("late", "string"), ("open", "boolean"),
        ("responsable", "bigint"), ("member", "bigint"), ("asesor", "string"), ("solicitud_id", "bigint"))}
    rows = asked.select(
        F.col("empresa_id").alias("empresa"), "solicitud_id", F.col("_lead").alias("lead"), "destino", F.col("_to").alias("to_"),
        F.col("_invalid").alias("invalid"), F.col("_late").alias("late"), F.col("_open").alias("open"), "responsable",
        F.col("_a_member").alias("member"), F.col("_a_asesor").alias("asesor"), F.lit(None).cast("bigint").alias("load"),
        F.lit(None).cast("bigint").alias("places"))
    free = room.select(F.col("empresa_id").alias("empresa"), F.col("asesor_id").alias("to_"), F.col("_load").alias("load"),
                       F.col("_places").cast("bigint").alias("places")).withColumns(nothing)
    free = free.join(rows.select("empresa").distinct(), "empresa", "left_semi")
    # a key of its own: a union of inputs that are dealt by company already is not dealt again
    dealt = free.unionByName(rows).repartition(F.xxhash64("empresa", F.lit(1))).sortWithinPartitions("empresa", F.col("solicitud_id").asc_nulls_first())
    return asked.join(dealt.mapInPandas(_walk, _OUTCOME), "solicitud_id")


def _in_rounds(asked: DataFrame, room: DataFrame) -> DataFrame:
    """Rounds of guesses until none changes.

    Each request's outcome depends on earlier requests alone, so there is one set of outcomes that
    agrees with itself: what a round leaves unchanged is what a pass in order would find. Every round
    settles each advisor's whole sequence, so the number of rounds is that of moves that free a place
    for one another in a chain, not of requests.
    """
    guess = cut_lineage(asked.withColumn("_granted", ~F.col("_invalid") & F.col("_late").isNull()))
    while True:
        judged = cut_lineage(_judged(guess))
        fits = _ledger(judged, room)
        now = F.col("_why").isNull() & (~F.col("_moves") | F.coalesce("_fits", F.lit(False)))
        after = cut_lineage(judged.join(fits, "solicitud_id", "left").withColumns({"_granted": now, "_guess": F.col("_granted")}))
        if after.where("_granted <> _guess").isEmpty():
            return after.drop("_guess", "_fits", "_from")
        guess = after.drop("_guess", "_fits", "_why", "_moves", "_owner", "_holder", "_from")


def _decided(requests: DataFrame, states: DataFrame, members: DataFrame, assignments: DataFrame, in_order: int) -> DataFrame:
    own = members.where("asesor_id is not null").select("membresia_id", "empresa_id", "asesor_id", "capacidad")
    load = assignments.select("membresia_id").join(own, "membresia_id").groupBy("empresa_id", "asesor_id").agg(
        F.count(F.lit(1)).alias("_load"))
    places = own.groupBy("empresa_id", "asesor_id").agg(F.max(F.coalesce("capacidad", F.lit(0))).alias("_places"))
    room = cut_lineage(places.join(load, ["empresa_id", "asesor_id"], "left").select(
        "empresa_id", "asesor_id", "_places", F.coalesce("_load", F.lit(0)).alias("_load")))
    asked = cut_lineage(_asked(requests, states, members, assignments))
    large = cut_lineage(asked.groupBy("empresa_id").count().where(F.col("count") > in_order).select("empresa_id"))
    decided = _in_order(asked.join(large, "empresa_id", "left_anti"), room)
    if not large.isEmpty():
        rounds = _in_rounds(asked.join(large, "empresa_id", "left_semi"), room)
        decided = decided.unionByName(rounds.select(decided.columns))
    return cut_lineage(decided)


def _positions(decided: DataFrame, assignments: DataFrame) -> DataFrame:
    """solicitud_id, posicion_inicial of granted moves: one more than the greatest place still held.

    A member's arrivals and departures pass through one task in order. What is held are the places of
    the day, as many as the member's capacity allows (and those given before), not the requests.
    """
    lead = ["empresa_id", "lead_consolidado_id"]
    moves = decided.where("_moves and _granted")
    rows = (
        assignments.select(F.col("membresia_id").alias("_m"), F.lit(None).cast("bigint").alias("solicitud_id"), null_safe_key(lead).alias("_lead"),
                           F.lit(0).alias("_kind"), F.col("posicion_inicial").cast("bigint").alias("_at"))
        .unionByName(moves.select(F.col("destino").alias("_m"), "solicitud_id", "_lead", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_at")))
        .unionByName(moves.select(F.col("_holder").alias("_m"), "solicitud_id", "_lead", F.lit(2).alias("_kind"), F.lit(None).cast("bigint").alias("_at"))))
    dealt = rows.repartition(F.xxhash64("_m", F.lit(1))).sortWithinPartitions("_m", F.col("solicitud_id").asc_nulls_first(), "_kind")
    return dealt.select("_m", "solicitud_id", "_lead", "_kind", "_at").mapInPandas(_give_places, "solicitud_id bigint, posicion_inicial bigint")


def _give_places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    member, held, top = None, {}, []
    for frame in frames:
        out = []
        for m, request, lead, kind, at in frame.itertuples(index=False, name=None):
            if m != member:
                member, held, top = m, {}, []
            if kind == 2:
                held.pop(lead, None)
                continue
            if kind == 1:
                while top and held.get(top[0][1]) != -top[0][0]:
                    heapq.heappop(top)  # given up meanwhile
                at = 1 - top[0][0] if top else 1
                out.append((request, at))
            elif pd.isna(at):
                continue
            held[lead] = at
            heapq.heappush(top, (-at, lead))
        yield pd.DataFrame(out, columns=["solicitud_id", "posicion_inicial"]).astype("int64")


def transfer_owners(requests: DataFrame, states: DataFrame, members: DataFrame, assignments: DataFrame,
                    in_order: int = IN_ORDER) -> tuple[DataFrame, DataFrame]:
    """Decide a batch of portfolio transfers, each as if those before it had been carried out.

    ``requests``: solicitud_id (a unique number, the order), empresa_id, lead_consolidado_id, destino.
    ``states``: lead columns, responsable, punto_venta_id. ``members``: membresia_id, empresa_id, rol,
    activa, asesor_id, punto_venta_id, capacidad. ``assignments`` (today): lead columns, membresia_id,
    estado, posicion_inicial. Returns (decisions, assignments after). An open assignment moves only
    into a free place of the target, and its former place is free for the requests behind it; a
    completed one keeps its advisor and still takes a place. ``anterior`` is the owner when the request
    was met. Companies with up to ``in_order`` requests are passed through in order, a company per task;
    the others are settled in rounds that spread every advisor over many tasks.
    """
    lead = ["empresa_id", "lead_consolidado_id"]
    decided = _decided(requests, states, members, assignments, in_order)
    placed = decided.join(_positions(decided, assignments), "solicitud_id", "left")
    reason = F.when(F.col("_why").isNotNull(), F.col("_why")).when(~F.col("_granted"), "sin_cupo").otherwise("transferido")
    decisions = cut_lineage(placed.select(
        "solicitud_id", *lead, "destino", F.col("_owner").alias("anterior"), reason.alias("decision"), "posicion_inicial"))
    last = F.max(F.struct("solicitud_id", F.col("destino").alias("_to"), F.col("posicion_inicial").alias("_pos")))
    moved = decisions.where("posicion_inicial is not null").groupBy(*lead).agg(last.alias("_last")).select(
        *lead, "_last._to", "_last._pos")
    after = assignments.join(moved, lead, "left").withColumns({
        "membresia_id": F.coalesce("_to", "membresia_id"),
        "posicion_inicial": F.coalesce("_pos", "posicion_inicial"),
    }).drop("_to", "_pos")
    return decisions, after


# worker functions travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
