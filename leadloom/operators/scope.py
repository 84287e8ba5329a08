"""Tenant and portfolio scoping: filter first, then count, page or aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ScopeError(PermissionError):
    """No authorised company for the read."""


def scoped(df: DataFrame, company: str | None) -> DataFrame:
    """Rows of one company; a missing scope raises instead of showing everything."""
    if company is None or not company.strip():
        raise ScopeError("a company scope is required")
    return df.where(F.col("empresa_id") == company.strip())


def scoped_children(child: DataFrame, parent: DataFrame, key: str, company: str) -> DataFrame:
    """Child rows whose parent belongs to the company."""
    return child.join(scoped(parent, company).select(key), key, "left_semi")


def usable_chats(chats: DataFrame, include_discarded: bool = False) -> DataFrame:
    """Chats still usable; discarded ones only with the supervisor's permission."""
    return chats if include_discarded else chats.where(~F.col("descartada"))


def active_membership(memberships: DataFrame, user: str, company: str) -> DataFrame:
    """The single active membership that authorises a user in a company."""
    return scoped(memberships, company).where((F.col("usuario") == user) & F.col("activa"))


def grants(states: DataFrame, captures: DataFrame, members: DataFrame) -> DataFrame:
    """What members may see: (membresia_id, empresa_id, lead_consolidado_id, todo).

    Supervisors see the company: one row with ``todo``, whatever the number of leads. Advisors see
    their own leads or the unassigned ones they captured: one row per lead. Inactive members and
    other roles see nothing. ``members``: (membresia_id, empresa_id, usuario, rol, activa).
    """
    m = members.where(F.col("activa") & F.col("rol").isin("asesor", "supervisor")).select(
        "membresia_id", "empresa_id", "usuario", "rol")
    boss = m.where(F.col("rol") == "supervisor").select(
        "membresia_id", "empresa_id", F.lit(None).cast("string").alias("lead_consolidado_id"),
        F.lit(True).alias("todo"))
    advisor = m.where(F.col("rol") == "asesor").select("membresia_id", "empresa_id", "usuario")
    own = states.join(
        advisor.select(F.col("membresia_id"), F.col("membresia_id").alias("responsable"),
                       "empresa_id"), ["empresa_id", "responsable"])
    captured = captures.select("empresa_id", "lead_consolidado_id", F.col("autor").alias("usuario")
                               ).distinct()
    free = (
        states.where(F.col("responsable").isNull())
        .join(captured, ["empresa_id", "lead_consolidado_id"])
        .join(advisor, ["empresa_id", "usuario"])
    )
    one = ["membresia_id", "empresa_id", "lead_consolidado_id", F.lit(False).alias("todo")]
    return boss.unionByName(own.select(*one)).unionByName(free.select(*one))


def visible_states(states: DataFrame, captures: DataFrame, member: DataFrame) -> DataFrame:
    """The portfolio of one member, or of a few: the states their grants lead to."""
    held = grants(states, captures, member)
    everything = states.join(
        held.where("todo").select("membresia_id", "empresa_id"), "empresa_id")
    single = states.join(
        held.where("NOT todo").select("membresia_id", "empresa_id", "lead_consolidado_id"),
        ["empresa_id", "lead_consolidado_id"])
    columns = ["membresia_id", *states.columns]
    return everything.select(*columns).unionByName(single.select(*columns))


def todays_queue(assignments: DataFrame, held: DataFrame, day: str) -> DataFrame:
    """A member's assignments of the day, limited to the leads still in their portfolio.

    ``held``: the grants. An assignment is checked against the member's grant of the company or of
    the lead, so no portfolio is spelled out.
    """
    today = assignments.where(F.col("fecha_operativa") == F.lit(day).cast("date"))
    company = held.where("todo").select("membresia_id", "empresa_id")
    single = held.where("NOT todo").select("membresia_id", "empresa_id", "lead_consolidado_id")
    keys = ["membresia_id", "empresa_id"]
    return today.join(company, keys, "left_semi").unionByName(
        today.join(company, keys, "left_anti").join(
            single, [*keys, "lead_consolidado_id"], "left_semi"))


def filter_states(states: DataFrame, estado: str = "", temperatura: str = "", sede: str = "",
                  seguimiento: str = "", revision: str = "", now=None) -> DataFrame:
    """Optional filters; an empty parameter filters nothing."""
    out = states
    if estado:
        out = out.where(F.col("estado") == estado)
    if revision:
        flag = F.col("requiere_revision") if "requiere_revision" in states.columns else F.col(
            "cola").startswith("revision")
        out = out.where(flag == F.lit(revision == "si"))
    if seguimiento:
        due = F.col("proxima_accion_en")
        out = out.where(due <= now if seguimiento == "vencido" else due > now)
    if temperatura:
        out = out.where(F.col("temperatura") == temperatura)
    if sede:
        out = out.where(F.col("punto_venta_id") == sede)
    return out
