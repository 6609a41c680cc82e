"""Road and place tags as columns: what a way is, who may use it, how fast, and what a turn costs.

Tags are maps of strings. All rules are built-in expressions, so they stay in one generated stage with the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tagging scheme and of the road model.
CLASSES = {"motorway": 0, "trunk": 1, "primary": 2, "secondary": 3, "tertiary": 4, "unclassified": 5, "residential": 6, "living_street": 7, "service": 8, "track": 9, "road": 10}
LINKED = ("motorway", "trunk", "primary", "secondary", "tertiary")
LINK, ROUNDABOUT, TUNNEL, BRIDGE, PRIVATE, MINOR_SERVICE = 1, 2, 4, 8, 16, 32
UNPAVED, URBAN, SIGNALS, ATTRIBUTES, CITY, BIG_CITY = 64, 128, 256, 512, 1024, 2048
UNPAVED_SURFACES = ("unpaved", "gravel", "fine_gravel", "compacted", "dirt", "earth", "ground", "grass", "sand", "mud", "pebblestone")
NAMED_LIMITS = {"UA:urban": 50, "UA:rural": 90, "UA:trunk": 110, "UA:motorway": 130, "UA:living_street": 20, "RU:urban": 60, "RU:rural": 90, "RU:motorway": 110, "RU:living_street": 20, "walk": 5}
ACCESS_KEYS = ("motorcar", "motor_vehicle", "vehicle", "access")
ACCESS_OPEN = ("yes", "designated", "permissive", "destination", "customers", "official", "unknown")
MINOR_SERVICES = ("driveway", "parking_aisle", "drive-through", "emergency_access")
PLACE_CATEGORIES = {"fuel": 1, "charging_station": 2, "cafe": 3, "fast_food": 4, "restaurant": 4, "pharmacy": 5, "parking": 6}
CLOSED_ACCESS, CLOSED_AMENITIES = ("private", "customers", "no"), ("fuel", "charging_station", "parking")
FUELS = {"fuel:diesel": 2, "fuel:lpg": 4, "fuel:octane_92": 8, "fuel:octane_95": 16, "fuel:octane_98": 32}
POI_KEYS = ("amenity", "shop", "tourism", "leisure", "office", "healthcare", "craft", "historic")
SPEED_KPH = (110, 90, 60, 50, 45, 35, 25, 8, 12, 10, 20)
CAP_KPH = (120, 110, 100, 90, 80, 60, 30, 10, 15, 15, 30)
DEFAULT_LIMITS = {"urban": 50, "living_street": 20, "motorway": 130, "rural": 90}


def tag(tags: Column, key: str) -> Column:
    """The trimmed value of a key; null if missing or blank."""
    return F.nullif(F.trim(F.try_element_at(tags, F.lit(key))), F.lit(""))


def first_tag(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(tag(tags, k) for k in keys))


def _table(names: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def speed_limit(tags: Column) -> Column:
    """The tagged limit in km/h, within 1 to 250; 0 if there is none or it cannot be read."""
    value = first_tag(tags, ("maxspeed", "maxspeed:forward", "maxspeed:backward"))
    pattern = r"^([0-9]+(?:\.[0-9]+)?)\s*(mph|km/h|kmh)?$"
    number = F.regexp_extract(value, pattern, 1).try_cast("double") * F.when(F.regexp_extract(value, pattern, 2) == "mph", 1.609344).otherwise(1.0)
    read = F.when(number.isNotNull(), F.least(F.lit(250), F.greatest(F.lit(1), F.bround(number).cast("int"))))
    return F.coalesce(F.try_element_at(_table(NAMED_LIMITS), value), read, F.lit(0))


def one_way(tags: Column, roundabout: Column) -> Column:
    """0 both ways, 1 along the way, 2 against it; roundabouts and motorways are one-way unless tagged."""
    value = F.try_element_at(tags, F.lit("oneway"))
    implied = value.isNull() & (roundabout | (tag(tags, "highway") == "motorway"))
    return F.when(value.isin("yes", "1", "true") | F.coalesce(implied, F.lit(False)), 1).when(value.isin("-1", "reverse"), 2).otherwise(0)


def road(tags: Column) -> Column:
    """A struct of cls, oneway, flags, maxspeed of a drivable way; null for all other ways."""
    highway = tag(tags, "highway")
    stem = F.when(highway.endswith("_link"), F.regexp_replace(highway, "_link$", ""))
    link = stem.isin(*LINKED)
    cls = F.coalesce(F.try_element_at(_table(CLASSES), highway), F.when(link, F.try_element_at(_table(CLASSES), stem)))
    access = F.transform(F.split(first_tag(tags, ACCESS_KEYS), ";"), lambda v: F.trim(v))
    shut = F.coalesce(F.array_distinct(access) == F.array(F.lit("no")), F.lit(False))
    private = ~F.coalesce(F.arrays_overlap(access, F.array(*map(F.lit, ACCESS_OPEN))), F.lit(True))
    roundabout = F.coalesce(tag(tags, "junction").isin("roundabout", "circular"), F.lit(False))
    given = lambda key: F.coalesce(F.try_element_at(tags, F.lit(key)) != "no", F.lit(False))
    signs = (
        (F.coalesce(link, F.lit(False)), LINK), (roundabout, ROUNDABOUT), (given("tunnel"), TUNNEL), (given("bridge"), BRIDGE), (private, PRIVATE),
        (F.coalesce((highway == "service") & tag(tags, "service").isin(*MINOR_SERVICES), F.lit(False)), MINOR_SERVICE),
        (F.coalesce(tag(tags, "surface").isin(*UNPAVED_SURFACES), F.lit(False)), UNPAVED),
    )
    flags = F.lit(ATTRIBUTES)
    for sign, bit in signs:
        flags = flags + F.when(sign, bit).otherwise(0)
    kept = cls.isNotNull() & ~F.coalesce(tag(tags, "area") == "yes", F.lit(False)) & ~shut
    return F.when(kept, F.struct(cls.alias("cls"), one_way(tags, roundabout).alias("oneway"), flags.alias("flags"), speed_limit(tags).alias("maxspeed")))


def restriction(tags: Column) -> Column:
    """1 for a turn that is forbidden, 2 for the only one allowed, null if cars are not meant."""
    value = first_tag(tags, ("restriction:motorcar", "restriction"))
    free = F.array_contains(F.transform(F.split(F.coalesce(F.try_element_at(tags, F.lit("except")), F.lit("")), ";"), lambda v: F.trim(v)), "motorcar")
    kind = F.when(value.startswith("no_"), 1).when(value.startswith("only_"), 2)
    return F.when((F.try_element_at(tags, F.lit("type")) == "restriction") & ~free, kind)


def place(tags: Column) -> Column:
    """A struct of category and flags (fuels sold) of a place to stop at; null where nobody may, or that is none."""
    amenity = tag(tags, "amenity")
    closed = amenity.isin(*CLOSED_AMENITIES) & F.coalesce(tag(tags, "access").isin(*CLOSED_ACCESS), F.lit(False))
    fuels = F.lit(0)
    for key, bit in FUELS.items():
        fuels = fuels + F.when(tag(tags, key) == "yes", bit).otherwise(0)
    category = F.try_element_at(_table(PLACE_CATEGORIES), amenity)
    return F.when(category.isNotNull() & ~closed, F.struct(category.alias("category"), F.when(amenity == "fuel", fuels).otherwise(0).alias("flags")))


def poi(tags: Column) -> Column:
    """'key=value' of the first key that names a point of interest and is not 'no'."""
    return F.coalesce(*(F.when(tag(tags, k) != "no", F.concat(F.lit(f"{k}="), tag(tags, k))) for k in POI_KEYS))


def entrance_number(tags: Column) -> Column:
    """ref, else unit, else a name of up to three letters or digits."""
    name = tag(tags, "name")
    return F.coalesce(first_tag(tags, ("ref", "addr:unit")), F.when(name.rlike(r"^[0-9\p{L}]{1,3}$"), name), F.lit(""))


def legal_limit(cls: Column, oneway: Column, flags: Column, maxspeed: Column) -> Column:
    """The limit that applies in km/h: the tag, else by class and settlement; null where a sign would mislead."""
    split = cls.isin(1, 2) & (oneway != 0) & ~has(flags, LINK | ROUNDABOUT)
    rule = F.when(maxspeed > 0, maxspeed).when(cls == 7, DEFAULT_LIMITS["living_street"]).when(cls == 0, DEFAULT_LIMITS["motorway"]).when(has(flags, URBAN), DEFAULT_LIMITS["urban"]).when(~split, DEFAULT_LIMITS["rural"])
    return F.when(has(flags, ATTRIBUTES) & ~has(flags, MINOR_SERVICE), rule)


def speed_mps(cls: Column, flags: Column, maxspeed: Column) -> Column:
    """Free driving speed: a share of the limit by surroundings up to the class's cap, less on links, roundabouts and unpaved roads."""
    at = lambda table: F.element_at(F.array(*(F.lit(float(v)) for v in table)), cls + 1)
    urban, great = has(flags, URBAN), has(flags, BIG_CITY) & cls.isin(1, 2, 3)
    limit = F.when(maxspeed > 0, maxspeed.cast("double")).when(cls == 0, 130.0).when(urban, 50.0).otherwise(90.0)
    share = F.when(great, 1.15).when(has(flags, CITY), 0.9).when(~urban, 1.1).when(cls <= 3, 1.3).otherwise(1.0)
    kph = F.least(limit * share, at(CAP_KPH))
    kph = F.when(great, F.least(kph, F.lit(70.0))).otherwise(kph)
    kph = F.when(has(flags, UNPAVED), F.least(kph, F.lit(30.0))).otherwise(kph)
    kph = F.when(has(flags, ATTRIBUTES), kph).otherwise(at(SPEED_KPH))
    kph = F.when(has(flags, LINK), kph * 0.6).otherwise(kph)
    return F.when(has(flags, ROUNDABOUT), F.least(kph, F.lit(30.0))).otherwise(kph) / 3.6


def edge_seconds(cls: Column, flags: Column, maxspeed: Column, metres: Column) -> Column:
    """Seconds over a whole edge, with the wait at a signalled crossing on it."""
    lights = has(flags, ATTRIBUTES) & has(flags, SIGNALS)
    return metres / speed_mps(cls, flags, maxspeed) + F.when(lights & (metres > 0), 5.0).otherwise(0.0)


def entry_seconds(cls: Column, flags: Column) -> Column:
    """What entering an edge costs beyond its time: private roads, driveways, tracks."""
    return F.when(has(flags, PRIVATE), 600.0).otherwise(0.0) + F.when(has(flags, MINOR_SERVICE), 60.0).otherwise(0.0) + F.when(cls == 9, 120.0).otherwise(0.0)


def turn_seconds(turn: Column) -> Column:
    """A turn in radians, clockwise positive: nothing up to 30 degrees, more to the left and from 120 degrees on."""
    a = F.abs(turn)
    return F.when(a < 0.5235987755982988, 0.0).when(a < 2.0943951023931953, F.when(turn > 0, 8.0).otherwise(15.0)).otherwise(F.when(turn > 0, 15.0).otherwise(20.0))


def pass_seconds(turn: Column, degree: Column, signals: Column, u_turn: Column, priority: Column) -> Column:
    """Passing a node: U-turn, or junction, turn and lights; straight on along a bigger road the junction is free."""
    junction = degree >= 3
    lights = F.when(signals, F.when(junction, 15.0).otherwise(5.0)).otherwise(0.0)
    turning = turn_seconds(turn)
    return F.when(u_turn, 30.0).when(~junction, lights).otherwise(F.when(priority & (turning == 0), 0.0).otherwise(turning + 2.0) + lights)
