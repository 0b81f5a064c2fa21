"""Classifiers: bands, ordered rules, bit sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def speed_band(share: Column) -> Column:
    return F.when(share.isNull(), "none").when(share >= 0.7, "flowing").when(share >= 0.45, "slow").when(share >= 0.2, "congested").otherwise("jammed")


def change_band(before: Column, after: Column, least: float = 60.0) -> Column:
    """Band of the change; NULL where little drives or little changes."""
    change = (after - before) / F.greatest(before, F.lit(1.0))
    band = F.when(change >= 0.3, "much more").when(change >= 0.1, "more").when(change <= -0.3, "much less").when(change <= -0.1, "less")
    return F.when(F.greatest(before, after) >= least, band)


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (substring, name) that the text holds."""
    found = F.lit(None)
    for part, name in reversed(rules):
        found = F.when(F.contains(text, F.lit(part)), name).otherwise(found)
    return F.coalesce(found, F.lit(default))


def road_class(limit_kmh: Column) -> Column:
    return F.when(limit_kmh >= 100, "motorway").when(limit_kmh >= 80, "state").when(limit_kmh >= 50, "main").otherwise("local")


#: vehicle class -> its bit, and the finer classes it stands for; fixed values
CLASSES = {
    "passenger": (1, ("passenger", "private", "evehicle", "motorcycle", "moped", "vip", "hov", "army")),
    "bus": (2, ("bus", "coach")),
    "tram": (4, ("tram",)),
    "truck": (8, ("truck", "trailer")),
    "rail": (16, ("rail", "rail_urban", "rail_electric", "rail_fast", "subway")),
    "bicycle": (32, ("bicycle",)),
    "pedestrian": (64, ("pedestrian",)),
    "delivery": (128, ("delivery",)),
    "taxi": (256, ("taxi",)),
    "emergency": (512, ("authority", "emergency")),
}


def permission_mask(allow: Column, disallow: Column, classes: dict[str, tuple[int, tuple[str, ...]]] = CLASSES) -> Column:
    """Bits of the classes that a lane lets in, of which a finer one at least is left: those that allow lists, else all but
    those that disallow lists (blank-separated; NULL: no list, and an empty allow list lets none in)."""
    bits = {fine: bit for bit, members in classes.values() for fine in members}
    every = F.array(*map(F.lit, bits))
    left = F.when(allow.isNotNull(), F.array_intersect(every, F.split(allow, "\\s+"))).when(disallow.isNotNull(), F.array_except(every, F.split(disallow, "\\s+"))).otherwise(every)
    known = F.create_map(*(F.lit(x) for pair in bits.items() for x in pair))
    return F.aggregate(left, F.lit(0), lambda mask, fine: mask.bitwiseOR(known[fine]))


def valid_at(start: Column, end: Column, now: Column) -> Column:
    """start <= now <= end with open ends."""
    return (start.isNull() | (start <= now)) & (end.isNull() | (now <= end))


def cheapest_tier(*tiers: Column) -> Column:
    return F.coalesce(*tiers)


#: tags of ways that are driven on, of services left out, and of tracks; fixed values
DRIVABLE = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service")
MINOR_SERVICE = ("parking_aisle", "driveway", "drive-through", "emergency_access")
TRACKS = ("tram", "rail", "light_rail")


def wanted_way(tags: Column) -> Column:
    """Whether a way (map of tags) is a road to drive on or a track."""
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    minor = (tag("highway") == "service") & tag("service").isin(*MINOR_SERVICE)
    return F.when(tag("highway").isin(*DRIVABLE), (tag("area") != "yes") & ~minor).otherwise(tag("railway").isin(*TRACKS))


#: kind -> (least footprint m2, height m), "" for other kinds; fixed values
HEIGHTS = {
    "minor": ((0, 3.0),),
    "house": ((0, 7.5),),
    "religious": ((0, 14.0),),
    "industrial": ((0, 9.0),),
    "civic": ((0, 12.0),),
    "commercial": ((0, 8.0), (1500, 12.0)),
    "residential": ((0, 9.0), (200, 15.0), (700, 21.0)),
    "": ((0, 3.0), (40, 7.0), (180, 10.0), (450, 14.0), (1500, 18.0)),
}
#: plan -> (least storeys around, zone); fixed values
ZONES = {
    "residential": ((0, "lowrise"), (1, "houses"), (3, "lowrise"), (7, "highrise")),
    "mixed": ((0, "mixed"),),
    "commercial": ((0, "shops"),),
    "office": ((0, "offices"),),
    "industrial": ((0, "industry"),),
    "": ((0, "none"),),
}
#: kind, or kind and land ("hall": large and low) -> shares of the floors for living, for work; fixed values
USES = {
    "house": (1.0, 0.0),
    "residential": (1.0, 0.0),
    "commercial": (0.0, 1.0),
    "industrial": (0.0, 1.0),
    "civic": (0.0, 1.0),
    "other residential": (1.0, 0.0),
    "other commercial": (0.0, 1.0),
    "other industrial": (0.0, 1.0),
    "other civic": (0.0, 1.0),
    "other hall": (0.0, 1.0),
    "other": (0.8, 0.2),
    "": (0.0, 0.0),
}


def stepped(key: Column, amount: Column, table: dict[str, tuple]) -> Column:
    """The value of the last step of the key's row (or the row "") that amount reaches."""
    steps = {k: F.array(*(F.struct(F.lit(float(least)).alias("least"), F.lit(v).alias("value")) for least, v in row)) for k, row in table.items()}
    known = F.create_map(*(x for k, row in steps.items() for x in (F.lit(k), row)))
    return F.try_element_at(F.filter(F.coalesce(F.try_element_at(known, key), steps[""]), lambda step: step["least"] <= amount), F.lit(-1))["value"]


def first_found(table: dict[str, tuple[float, ...]], *keys: Column) -> Column:
    """The row of the first key that the table has, else the row "": an array."""
    known = F.create_map(*(x for k, row in table.items() for x in (F.lit(k), F.array(*map(F.lit, row)))))
    return F.coalesce(*(F.try_element_at(known, k) for k in keys), F.array(*map(F.lit, table[""])))


def estimated_height(kind: Column, area: Column, levels: Column, roof_levels: Column, level_height: float = 3.0) -> Column:
    """Height (m): of the mapped storeys, roof storeys and a metre of roof, else by kind and footprint."""
    mapped = levels * level_height + F.coalesce(roof_levels, F.lit(0)) * 2.5 + 1.0
    return F.coalesce(F.when(levels > 0, mapped), stepped(kind, area, HEIGHTS))


def default_roof(kind: Column, area: Column, height: Column) -> Column:
    """Small low buildings that people live in or keep things in have a gable."""
    gabled = F.array_contains(F.array(F.lit("house"), F.lit("other"), F.lit("minor")), kind) & (area < 300) & (height <= 10)
    return F.when(gabled, "gabled").otherwise("flat")


def storeys(levels: Column, eave: Column, storey: float = 3.0) -> Column:
    """Mapped levels, else the walls' height over a typical storey."""
    return F.when(levels > 0, levels.cast("double")).otherwise(F.greatest(F.lit(1.0), F.bround(eave / storey)))


def use_shares(kind: Column, land: Column, area: Column, eave: Column, centre: Column, centre_work: float = 0.3) -> tuple[Column, Column]:
    """Shares of a building's floor area for living and for work: by kind and land; homes in the centre, and houses and flats
    on commercial land, give up what is missing to centre_work."""
    size = F.when((area >= 2000) & (eave <= 15), F.concat(kind, F.lit(" hall")))
    home, work = (first_found(USES, F.concat(kind, F.lit(" "), land), size, kind)[i] for i in (0, 1))
    dwelling = F.concat_ws("/", kind, land).isin("house/commercial", "residential/commercial")
    moved = F.when((centre | dwelling) & (home > 0), F.greatest(centre_work - work, F.lit(0.0))).otherwise(0.0)
    return F.least(home, 1 - moved - work), work + moved


def planned_zone(plan: Column, storeys_around: Column) -> Column:
    """Zone of a lot by its plan and, for homes, the storeys around it."""
    return stepped(plan, storeys_around, ZONES)
