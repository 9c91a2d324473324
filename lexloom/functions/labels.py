"""Label mappings as columns over map literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import vocabulary as V


def look_up(table: dict, key: Column) -> Column:
    """table[key], null where there is none; values are strings or lists of strings."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def _at(pos: Column, i: int) -> Column:
    return F.get(pos, i)


def atom_type(pos: Column) -> Column:
    """Atom type of a part-of-speech list: names and numbers by its second field, copulas by its fifth."""
    noun = F.when(_at(pos, F.lit(0)) == "名詞", look_up(V.NOUN_DETAIL, _at(pos, F.lit(1))))
    copula = F.when((_at(pos, F.lit(0)) == "助動詞") & _at(pos, F.lit(4)).isin(V.COPULA_TYPES), "COPULA")
    return F.coalesce(noun, copula, look_up(V.POS_ATOM, _at(pos, F.lit(0))), F.lit("OTHER"))


def particle_function(surface: Column, pos: Column, case: Column) -> Column:
    """Null unless a particle; に and で are unknown without a case that decides them."""
    told = (
        F.when((surface == "に") & (case == "LOC"), "LOCATION").when((surface == "に") & (case == "DIR"), "DIRECTION").when((surface == "に") & (case == "TIME"), "TIME")
        .when((surface == "と") & (case == "QUOTE"), "QUOTATIVE").when((surface == "で") & (case == "LOC"), "LOCATION")
    )
    open_ = F.when(surface.isin("に", "で"), "UNKNOWN")
    known = F.coalesce(told, open_, look_up(V.PARTICLE_SURFACE, surface), look_up(V.PARTICLE_DETAIL, _at(pos, F.lit(1))), F.lit("UNKNOWN"))
    return F.when(_at(pos, F.lit(0)) == "助詞", known)


def inflections(surface: Column, normalized: Column, form: Column) -> Column:
    """The sorted union of the flags of the three tables."""
    none = F.array().cast("array<string>")
    found = [F.coalesce(look_up(t, k), none) for t, k in ((V.INFLECTION_NORMALIZED, normalized), (V.INFLECTION_FORM, form), (V.INFLECTION_SURFACE, surface))]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def bunsetsu_role(dependency: Column, function: Column, is_predicate: Column) -> Column:
    """Topic, then predicate, then by dependency."""
    told = F.when(function == "TOPIC", "TOPIC").when(is_predicate, "PREDICATE")
    return F.coalesce(told, look_up(V.DEPENDENCY_ROLE, F.lower(dependency)), F.lit("UNKNOWN"))
