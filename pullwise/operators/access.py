"""Role-based access decisions, role scopes and the functions a role may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import masks

PURPOSE_BIT = {p: 1 << i for i, p in enumerate(dims.PURPOSES)}


def _bits(names, table) -> int:
    out = 0
    for n in names:
        out |= table[n]
    return out


ROLE_PURPOSES = {r: _bits(v["purposes"], PURPOSE_BIT) for r, v in dims.ROLES.items()}
ROLE_ARTEFACTS = {r: _bits(v["artefacts"], dims.ARTEFACT_BIT) for r, v in dims.ROLES.items()}


def role_scope(role: str) -> dict:
    """A role's derived scope: lawful for one of its purposes and carried by one of its artefacts."""
    spec = dims.ROLES[role]
    by_purpose = _bits([c for p in spec["purposes"] for c in dims.PURPOSE_POLICY[p]["allowed"]], dims.CATEGORY_BIT)
    by_artefact = _bits([c for a in spec["artefacts"] for c in dims.ARTEFACTS[a][1]], dims.CATEGORY_BIT)
    layers = sorted({dims.ARTEFACTS[a][0] for a in spec["artefacts"]})
    return {"allowed": by_purpose & by_artefact, "withheld": dims.ALL_CATEGORIES_MASK & ~(by_purpose & by_artefact),
            "layers": layers}


def unassigned_artefacts() -> list[str]:
    granted = {a for v in dims.ROLES.values() for a in v["artefacts"]}
    return sorted(set(dims.ARTEFACTS) - granted)


def authorise(requests: DataFrame) -> DataFrame:
    """Decides requests(role, purpose, artefacts array, categories array or null).

    First reason that applies: unknown artefact (SS-01), purpose not the role's (PL-01), category not
    necessary for the purpose (DM-01), artefact the role does not handle (SS-01). Pure expressions."""
    known = list(dims.ARTEFACTS)
    unknown = F.array_sort(F.filter("artefacts", lambda a: ~a.isin(*known)))
    wanted = F.aggregate(F.col("categories"), F.lit(0), lambda acc, c: acc.bitwiseOR(masks.category_bit(c)))
    r = requests.withColumns({
        "_unknown": unknown, "_arts": masks.artefact_mask(F.col("artefacts")),
        "_cats": F.coalesce(wanted, masks.artefact_categories(F.col("artefacts"))),
        "_role_purposes": masks.choose(F.col("role"), ROLE_PURPOSES, 0),
        "_role_arts": masks.choose(F.col("role"), ROLE_ARTEFACTS, 0),
        "_purpose": masks.choose(F.col("purpose"), PURPOSE_BIT, 0)})
    excess = masks.minus(F.col("_cats"), masks.allowed_mask(F.col("purpose")))
    outside = masks.minus(F.col("_arts"), F.col("_role_arts"))
    rule = (F.when(F.size("_unknown") > 0, "SS-01").when(F.col("_role_purposes").bitwiseAND(F.col("_purpose")) == 0, "PL-01")
            .when(excess != 0, "DM-01").when(outside != 0, "SS-01"))
    listed = F.array_sort(F.filter(F.array_distinct("artefacts"), lambda a: masks.choose(a, dims.ARTEFACT_BIT, 0).bitwiseAND(
        F.col("_role_arts")) == 0))
    return r.withColumn("rule_id", rule).withColumns({
        "allowed": F.col("rule_id").isNull(),
        "denied_artefacts": F.when(F.size("_unknown") > 0, F.col("_unknown"))
        .when((F.col("rule_id") == "SS-01"), listed).otherwise(F.array().cast("array<string>")),
        "denied_categories": F.when(F.col("rule_id") == "DM-01", masks.category_names(excess)).otherwise(F.array().cast("array<string>")),
    }).drop("_unknown", "_arts", "_cats", "_role_purposes", "_role_arts", "_purpose")


def function_requests(df: DataFrame, function: Column) -> DataFrame:
    """Turns a function id into the request the gate decides (purpose, artefacts, categories)."""
    def arr(names) -> Column:
        return F.lit(None).cast("array<string>") if names is None else F.array(*[F.lit(n) for n in names])
    return df.withColumns({
        "purpose": masks.choose(function, {f: v[1] for f, v in dims.FUNCTIONS.items()}),
        "artefacts": masks.choose(function, {f: arr(v[2]) for f, v in dims.FUNCTIONS.items()}, arr(None)),
        "categories": masks.choose(function, {f: arr(v[3]) for f, v in dims.FUNCTIONS.items() if v[3]}, arr(None)),
        "function_group": masks.choose(function, {f: v[0] for f, v in dims.FUNCTIONS.items()})})


def permitted_functions(role: str) -> list[str]:
    """The functions a role may use: the same decision, over the configured function table."""
    scope, out = dims.ROLES[role], []
    for f, (_, purpose, artefacts, cats) in dims.FUNCTIONS.items():
        touched = set(cats) if cats else {c for a in artefacts for c in dims.ARTEFACTS[a][1]}
        if (purpose in scope["purposes"] and touched <= set(dims.PURPOSE_POLICY[purpose]["allowed"])
                and set(artefacts) <= set(scope["artefacts"])):
            out.append(f)
    return out


def layer_pages(modules: DataFrame) -> DataFrame:
    """Artefact -> page of the module of its layer (the last one listed), per site."""
    arts = F.array(*[F.struct(F.lit(a).alias("artefact"), F.lit(layer).alias("layer")) for a, (layer, _) in dims.ARTEFACTS.items()])
    last = modules.groupBy("site", "layer").agg(F.max_by("path", "ord").alias("path"))
    same = F.filter(arts, lambda a: a["layer"] == F.col("layer"))
    return last.select("site", "path", F.explode(same).alias("a")).select("site", "a.artefact", "path")
