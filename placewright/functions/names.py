"""Names of places, lines and stations as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists on which place resolution depends.
STOP = "the at of and a an for to in on & - | de la el".split()
GENERIC = (
    "park parks hospital hospitals medical center centre garden gardens plaza square playground dog play area "
    "community memorial public open space regional county city state mini neighborhood playlot field fields "
    "clinic health care services service foundation trail shoreline preserve reserve creek lake pond grove "
    "campus medicine skatepark skate rec recreation library libraries branch "
    "street st avenue ave road rd boulevard blvd way drive dr lane ln court ct place pl highway hwy terrace circle row "
    "consulate consulates consulado consulados consul consular general embassy honorary office "
    "san francisco jose oakland california ca bay north south east west"
).split()
STRUCTURAL = (
    "entrance exit parking lot garage valet drop off loading dock helipad ambulance building bldg wing annex pavilion "
    "suite ste floor basement department dept radiology imaging pharmacy laboratory lab cafeteria gift shop store member "
    "registration admitting box office ticket kiosk restroom main north south east west no number staging station ranger"
).split()
FOLD_WEAK = (
    "valley hill hills heights canyon ridge point waterfront linear spur town upper lower north south east west old new "
    "main river bay island meadow meadows vista view highland highlands mission willow cedar"
).split()
SUB_PARTS = (
    r"\b(entrance|exit|parking|garage|valet|drop[\s-]?off|loading dock|helipad|ambulance|building|bldg|wing|annex|"
    r"pavilion|suite|ste|floor|basement|department|dept|radiology|imaging|pharmacy|laborator(y|ies)|cafeteria|gift shop|"
    r"member services|registration|admitting|box office|ticket|kiosk|restroom)\b"
)
SPECIALTY = (
    r"\b(internal medicine|family medicine|sports medicine|sleep medicine|primary care|urgent care|maternal|fetal|"
    r"pediatric|paediatric|obstetric|gyne?colog|cardiolog|dermatolog|ophthalmolog|optometr|psychiatr|oncolog|radiolog|"
    r"imaging|orthop.?dic|urolog|neurolog|gastroenterolog|endocrinolog|rheumatolog|allergy|immunolog|nephrolog|pulmonolog|"
    r"physical therapy|occupational therapy|rehab|infusion|dialysis|chemical dependency)\b"
)
ANCHORS = {
    "hospital": ["medical center", "medical centre", "medical foundation", "hospital"],
    "museum": ["museum"],
    "library": ["library", "biblioteca"],
    "movie_theater": ["cinema", "theatre", "theater", "cineplex"],
    "zoo": ["zoo"],
    "aquarium": ["aquarium"],
    "amusement_park": ["amusement", "theme park"],
    "park": ["regional park", "state park", "national park", "preserve", "reserve", "open space", "park"],
    "golf_course": ["golf", "country club"],
    "consulate": ["consulate", "consulado", "embassy"],
    "mountain": ["mountain", "peak", "mount ", "mt "],
    "stadium": ["stadium", "park", "arena", "center", "coliseum", "ballpark", "field"],
}
PARK_SUBFEATURE = (
    r"\b(dog\s*(park|run|play|training)|off[-\s]?leash|community\s+garden|instructional\s+garden|demonstration\s+garden|"
    r"skate\s*park|staging\s+area|trail\s*head|entrance|boat\s+launch|kayak\s+launch)\b"
)
PARK_SPARSE = (
    r"\b(regional|state\s+(park|recreation|seashore)|open\s+space|preserve|reserve|wilderness|watershed|national|wildlife|"
    r"canyon|ridge|shoreline|seashore|mountain|peak|summit|recreation\s+area)\b"
)
AUTO_DROP = {"library": r"\bhigh school\b|\blittle free librar"}
SYSTEM_ORDER = ["BART", "Caltrain", "VTA", "Muni", "SFO AirTrain"]
SUFFIXED_AGENCIES = ["BART", "Caltrain", "VTA", "Muni"]
STREET_ABBREVIATIONS = {"Street": "St", "Avenue": "Ave", "Boulevard": "Blvd", "Drive": "Dr"}
# End of the fixed values.

_U = "(?U)"  # Unicode letters and digits in \w


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _has(name: Column, pattern: str) -> Column:
    return F.coalesce(name.rlike("(?iU)" + pattern), F.lit(False))


def match_norm(name: Column) -> Column:
    """F14. Lower case, & and + as 'and', punctuation as blanks, single blanks."""
    s = F.replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(s, _U + r"[^\w\s]", " "), _U + r"\s+", " "))


def _tokens(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(text), _U + r"[^\w\s]", " ")
    return F.filter(F.split(clean, _U + r"\s+"), lambda w: (w != "") & ~w.isin(STOP))


def sig_tokens(name: Column) -> Column:
    """F15. The distinct words before the first | ( : or dash, without stop words, sorted."""
    return F.array_sort(F.array_distinct(_tokens(F.split(name, "[|(:—–]")[0])))


def distinctive(name: Column, drop_structural: bool = False) -> Column:
    """F16. The significant words that are neither numbers nor generic (nor structural)."""
    out = F.array_except(F.filter(sig_tokens(name), lambda w: ~w.rlike(r"^\d+$")), _words(GENERIC))
    return F.array_except(out, _words(STRUCTURAL)) if drop_structural else out


def distinctive_full(name: Column) -> Column:
    """F16. The same over the whole name, less generic and structural words."""
    out = F.array_sort(F.array_distinct(F.filter(_tokens(name), lambda w: ~w.rlike(r"^\d+$"))))
    return F.array_except(F.array_except(out, _words(GENERIC)), _words(STRUCTURAL))


def is_sub(name: Column) -> Column:
    """F17. Whether a name is that of a piece of a larger place: an address, a lettered building, a structural word."""
    return _has(name, r"^\s*\d{2,6}\s+[a-z]") | _has(name, r"\bbuilding\s+[a-z0-9]\b") | _has(name, SUB_PARTS)


def is_specialty(name: Column) -> Column:
    return _has(name, SPECIALTY)


def anchor_hit(name: Column, category: Column) -> Column:
    low = F.lower(name)
    hits = [(category == c) & reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ws]) for c, ws in ANCHORS.items()]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def has_qualifier(name: Column) -> Column:
    return name.rlike("[:|]") | F.trim(name).rlike(r"\([^)]*\)\s*$")


def is_subset(a: Column, b: Column) -> Column:
    """Words a all among words b, a not empty and not equal to b."""
    return (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def auto_dropped(category: Column, name: Column) -> Column:
    """P9. Names that are never a valid place of their category."""
    return reduce(lambda a, b: a | b, [(category == c) & _has(name, p) for c, p in AUTO_DROP.items()])


def alt_names(name: Column, aka: Column) -> Column:
    """F18. Other names, streets abbreviated, without repeats and without the name itself (letter case aside)."""

    def brief(c: Column) -> Column:
        return reduce(lambda x, kv: F.regexp_replace(x, rf"\b{kv[0]}\b", kv[1]), STREET_ABBREVIATIONS.items(), c)

    start = F.array().cast("array<string>")

    def add(acc: Column, n: Column) -> Column:
        low = F.transform(acc, lambda x: F.lower(x))
        new = (F.lower(n) != F.lower(brief(name))) & (F.lower(n) != F.lower(name)) & ~F.array_contains(low, F.lower(n))
        return F.when(new, F.concat(acc, F.array(n))).otherwise(acc)

    return F.aggregate(F.transform(aka, brief), start, add)


def clean_city(city: Column) -> Column:
    """F19. Without 'city', 'town' or 'CDP' at the end; an empty name is null."""
    return F.nullif(F.trim(F.regexp_replace(city, r"\s+(city|town|CDP)$", "")), F.lit(""))


def clean_county(county: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(county, r"\s+County$", "")), F.lit(""))


def name_length(name: Column) -> Column:
    """F13. Characters of a name without the agency in brackets at its end."""
    return F.length(F.regexp_replace(name, rf"\s*\(({'|'.join(SUFFIXED_AGENCIES)})\)\s*$", ""))


def month_year(date: Column) -> Column:
    """F20. m/d/yyyy -> 'Jan 2024'; null if it isn't one."""
    return F.date_format(F.try_to_timestamp(date, F.lit("M/d/yyyy")), "MMM yyyy")


def map_link(base: str, lat: Column, lon: Column, place_id: Column) -> Column:
    """F21. A search link with encoded coordinates and, if known, the place's id."""
    more = F.when(F.coalesce(place_id, F.lit("")) != "", F.concat(F.lit("&query_place_id="), F.url_encode(place_id))).otherwise("")
    return F.concat(F.lit(base + "?api=1&query="), F.url_encode(F.concat_ws(",", lat.cast("string"), lon.cast("string"))), more)


def primary_system(systems: Column) -> Column:
    """P26. The first system in canonical order; null if none is known."""
    return F.get(F.filter(_words(SYSTEM_ORDER), lambda x: F.array_contains(systems, x)), F.lit(0))


def agency_of(line: Column) -> Column:
    """P26. The agency whose name a line starts with, BART for the bare colour lines."""
    return reduce(lambda a, s: a.when(line.startswith(s), s), SYSTEM_ORDER[1:4], F.when(line.startswith("SFO AirTrain"), "SFO AirTrain")).otherwise("BART")


def line_labels(lines: Column, primary: Column) -> Column:
    """P28. Line names for a list: the primary system's prefix is cut, a bare system name goes."""
    cut = F.transform(lines, lambda x: F.when(x.startswith(F.concat(primary, F.lit(" "))), F.substr(x, F.length(primary) + 2)).otherwise(x))
    return F.array_join(F.filter(cut, lambda x: x != primary), ", ")


def searchable(*columns: Column) -> Column:
    """P14. One lower-case text of several fields; arrays are spread, brackets in them cut."""
    return F.lower(F.concat_ws(" ", *columns))


def without_brackets(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.regexp_replace(x, r"\s*\([^)]*\)", ""))


def route_system(operator: Column, network: Column, mode: Column) -> Column:
    """P19. The system of a route by operator and network only; cable cars are out."""
    said = F.lower(F.concat_ws(" ", operator, network))
    return (
        F.when(F.lower(mode) == "cable_car", F.lit(None))
        .when(said.contains("bart") | said.contains("bay area rapid transit"), "BART")
        .when(said.contains("caltrain"), "Caltrain")
        .when(said.contains("vta") | said.contains("santa clara valley"), "VTA")
        .when(said.contains("muni") | said.contains("sfmta"), "Muni")
        .when(said.contains("airtrain"), "SFO AirTrain")
    )


def line_name(system: Column, ref: Column, name: Column) -> Column:
    """P20. The canonical name of a line from its reference or, without one, its long name before a colon."""
    head = F.trim(F.split(F.coalesce(name, F.lit("")), ":")[0])
    own = F.coalesce(F.nullif(F.trim(ref), F.lit("")), F.nullif(head, F.lit("")))
    return F.when(own.startswith(system), own).otherwise(F.concat_ws(" ", system, own))


def colour(tag: Column, fallback: Column, remap: dict[str, str]) -> Column:
    """P21. The tag, else the fallback; some values are replaced."""
    c = F.lower(F.coalesce(F.nullif(tag, F.lit("")), fallback))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in remap.items() for x in kv])[c], c) if remap else c


def peak_class(ele_m: Column, name: Column) -> Column:
    """P23. 'peak' from 1500 ft on, 'minor' below or by name, null without an elevation."""
    ft = ele_m.try_cast("double") * 3.280839895
    return F.when(ft.isNull(), F.lit(None)).when(_has(name, r"\b(knoll|hillock|unnamed)\b"), "minor").when(ft >= 1500, "peak").otherwise("minor")


# Names of small waters that are never listed, and the words that a bay or a reservoir must have.
SMALL_WATER = r"(Cove|Slough|Harbor|Harbour|Channel|Basin|Forebay|Pond|Dam|Arroyo|River|Strait Yacht|Yacht|Marina|estuarial)"
BAY_WORDS = ("Bay", "Strait", "Break", "Lagoon")
RESERVOIR_WORDS = ("Reservoir", "Lake")


def water_class(natural: Column, water: Column, name: Column) -> Column:
    """P23. 'bay', 'lake', 'lagoon' or 'reservoir' for waters worth listing, null for others and for nameless ones.

    Small waters by name are left out; a bay and a reservoir need one of their words, in that case, in the name.
    """
    kind = F.when(natural == "bay", "bay").when(water.isin("lake", "lagoon", "reservoir"), water)
    has = lambda words: name.rlike("|".join(words))
    named = F.when(kind == "bay", has(BAY_WORDS)).when(kind == "reservoir", has(RESERVOIR_WORDS)).otherwise(kind.isNotNull() & (name != ""))
    return F.when(named & ~_has(name, SMALL_WATER), kind)
