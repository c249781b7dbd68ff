"""Text rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that decide the cause of an event.
RAIN_WORDS = ["rain", "cloud", "flash", "flood", "torrential"]
NOT_RAIN_WORDS = ["glacier", "avalanche"]
# District names in alert text, English and Hindi.
DISTRICT_ALIASES = {
    "Almora": ["almora", "अल्मोड़ा"],
    "Bageshwar": ["bageshwar", "बागेश्वर"],
    "Chamoli": ["chamoli", "चमोली"],
    "Champawat": ["champawat", "चंपावत", "चम्पावत"],
    "Dehradun": ["dehradun", "dehra dun", "देहरादून"],
    "Haridwar": ["haridwar", "hardwar", "हरिद्वार"],
    "Nainital": ["nainital", "नैनीताल"],
    "Pauri Garhwal": ["pauri", "पौड़ी"],
    "Pithoragarh": ["pithoragarh", "पिथौरागढ़"],
    "Rudraprayag": ["rudraprayag", "रुद्रप्रयाग"],
    "Tehri Garhwal": ["tehri", "टिहरी"],
    "Udham Singh Nagar": ["udham singh nagar", "udhamsingh nagar", "u.s. nagar", "ऊधम सिंह नगर", "उधम सिंह नगर"],
    "Uttarkashi": ["uttarkashi", "उत्तरकाशी"],
}
STATE_ALIASES = ["uttarakhand", "uttaranchal", "उत्तराखंड", "उत्तराखण्ड"]
OFFICES = ["dehradun", "uttarakhand"]
# Words in the names of places that cannot take people in, or are no hospitals.
UNSUITABLE_SHELTER = (
    r"(?i)\b(caves?|gazebo|metal roof|shepherd|campsite|rain shelter|bugyal|nursing|senior living|villas?|apartments?"
    r"|boat club|house|homeopathic|hospital|gaushala)\b"
)
SPECIALIST_ONLY = r"(?i)\b(dental|dentist|eye|eyes|ent|laser|ivf|fertility|veterinary|vet|optical)\b"
TESTS_ONLY = r"(?i)\b(diagnostics?|pathology|labs?|laboratory|imaging|x-?ray)\b"
GENERAL_CARE = r"(?i)\b(general|maternity|multi-?speciality|medical college|district|civil|combined)\b"


def contains_any(text: Column, words: list[str]) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    out = lowered.contains(words[0])
    for word in words[1:]:
        out = out | lowered.contains(word)
    return out


def cause_class(cause: Column) -> Column:
    """rain, glacier, landslide or other; rain words are looked for first."""
    return (
        F.when(contains_any(cause, RAIN_WORDS), "rain")
        .when(contains_any(cause, NOT_RAIN_WORDS), "glacier")
        .when(contains_any(cause, ["landslide"]), "landslide")
        .otherwise("other")
    )


def names_in(text: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Sorted array of the names any of whose aliases occur in the text."""
    table = aliases or DISTRICT_ALIASES
    found = F.array(*[F.when(contains_any(text, words), name) for name, words in sorted(table.items())])
    return F.sort_array(F.filter(found, lambda x: x.isNotNull()))


def names_or_all(text: Column, aliases: dict[str, list[str]] | None = None) -> tuple[Column, Column]:
    """(names, statewide): all names when the text has none."""
    table = aliases or DISTRICT_ALIASES
    found = names_in(text, table)
    none = F.size(found) == 0
    return F.when(none, F.array(*[F.lit(n) for n in sorted(table)])).otherwise(found), none


def mentions(texts: DataFrame, text_id: str, text: str, names: DataFrame) -> DataFrame:
    """(text_id, name) for every name of a table that occurs in a text as whole words; case is ignored.

    Each text is cut into the word runs as long as some name and joined on them, so the work is an equi-join
    and grows with the text, not with texts times names. ``names``: name, alias.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    keyed = names.select("name", F.array_join(words(F.col("alias")), " ").alias("run"), F.size(words(F.col("alias"))).alias("len"))
    lengths = [r[0] for r in keyed.select("len").distinct().limit(33).collect()]
    if len(lengths) > 32:
        raise ValueError("names of more than 32 different lengths")
    tokens = texts.select(text_id, words(F.col(text)).alias("_w"))

    def runs_of(n: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.size("_w") - n + 1)
        every = F.transform(starts, lambda i: F.array_join(F.slice("_w", i, n), " "))
        return tokens.filter(F.size("_w") >= n).select(text_id, F.explode(F.array_distinct(every)).alias("run"))

    runs = None
    for n in lengths:
        runs = runs_of(n) if runs is None else runs.unionByName(runs_of(n))
    # Auto-broadcast applies only while the name table is below the threshold.
    return runs.join(keyed.select("name", "run"), "run").select(text_id, "name").distinct()


def fold(text: Column) -> Column:
    """Lower case without diacritics: compatibility decomposition is replaced by a table of Latin letters."""
    # Accented Latin letters and their plain forms.
    accented = "àáâãäåāăąçćčďèéêëēĕėęěìíîïĩīĭįñńňòóôõöøōŏőřśşšṣťṭùúûüũūŭůűýÿžźżḍṇṅḥṁṃ"
    plain = "aaaaaaaaacccdeeeeeeeeeiiiiiiiinnnooooooooorssssttuuuuuuuuuyyzzzdnnhmm"
    return F.translate(F.lower(text), accented, plain)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, ignoring case."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def correct_spelling(queries: DataFrame, query: str, places: list[str], least: float = 0.6) -> Column:
    """The query with its first comma-separated part replaced by the most similar known place.

    Unchanged when nothing is similar enough or the part is already a known place. First best wins.
    """
    from ridgewater.functions.columns import let

    first = F.trim(F.element_at(F.split(F.col(query), ","), 1))
    scored = F.array(
        *[F.struct(similarity(first, F.lit(p)).alias("score"), F.lit(-i).alias("i"), F.lit(p).alias("place")) for i, p in enumerate(places)]
    )
    whole = F.col(query)
    at = F.position(first, whole)

    def fixed(best: Column) -> Column:
        wanted = (F.length(first) > 0) & (best.score >= least) & (F.lower(best.place) != F.lower(first))
        swapped = F.concat(F.left(whole, at - 1), best.place, F.substr(whole, at + F.length(first)))
        return F.when(wanted, swapped).otherwise(whole)

    return let(F.array_max(scored), fixed)


def indian_mobile(value: Column) -> Column:
    """+91 and ten digits, or null."""
    # Fixed value: the accepted forms of a number.
    digits = F.regexp_extract(F.regexp_replace(value, r"[\s\-().]", ""), r"^(?:\+?91|0)?([6-9]\d{9})$", 1)
    return F.when(F.length(digits) == 10, F.concat(F.lit("+91"), digits))


def person_name(value: Column, longest: int = 40) -> Column:
    """Letters (Latin or Devanagari), spaces, apostrophes and hyphens only."""
    # Fixed value: the characters that may stand in a name.
    kept = F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-zऀ-ॿ\s'-]", "")
    return F.substring(F.trim(F.regexp_replace(kept, r"\s+", " ")), 1, longest)


def client_hash(report_id: Column, client: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", report_id.cast("string"), client.cast("string")), 256), 1, 32)


def network_key(address: Column) -> Column:
    """IPv6 addresses as their /64 network, others unchanged. Accepts :: abbreviations."""
    head = F.filter(F.split(F.substring_index(address, "::", 1), ":"), lambda x: x != "")
    tail = F.filter(F.split(F.when(address.contains("::"), F.substring_index(address, "::", -1)).otherwise(""), ":"), lambda x: x != "")
    gap = F.greatest(F.lit(0), F.lit(8) - F.size(head) - F.size(tail))
    groups = F.concat(head, F.array_repeat(F.lit("0"), gap), tail)
    hex4 = F.transform(F.slice(groups, 1, 4), lambda x: F.regexp_replace(F.lower(x), r"^0+(?=.)", ""))
    known = address.rlike(r"^[0-9A-Fa-f:]+$") & address.contains(":") & (F.size(groups) == 8)
    return F.when(known, F.concat(F.array_join(hex4, ":"), F.lit("::/64"))).otherwise(address)


def accuracy_km(value: Column) -> Column:
    """exact or 0km -> 0, "Nkm" -> N, anything else null."""
    text = F.lower(F.trim(value))
    return F.when(text.isin("exact", "0km"), 0.0).otherwise(
        F.when(text.endswith("km"), F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d*)?)\s*km$", 1).try_cast("double"))
    )


# Stated accuracies from fine to coarse.
ACCURACY_ORDER = ["1km", "5km", "10km", "25km", "50km"]


def accuracy_within(value: Column, cut: str, keep_exact: bool = False) -> Column:
    kept = ACCURACY_ORDER[: ACCURACY_ORDER.index(cut) + 1] + (["exact"] if keep_exact else [])
    return F.coalesce(value.isin(*kept), F.lit(False))


def is_evacuation_shelter(kind: Column, name: Column) -> Column:
    return (kind == "shelter") & ~F.coalesce(name, F.lit("")).rlike(UNSUITABLE_SHELTER)


def is_emergency_hospital(name: Column) -> Column:
    """General care always counts; specialists and pure test labs do not."""
    n = F.coalesce(name, F.lit(""))
    return (
        F.when(n.rlike(GENERAL_CARE), True)
        .when(n.rlike(SPECIALIST_ONLY), False)
        .otherwise(~(n.rlike(TESTS_ONLY) & ~n.rlike(r"(?i)\bhospital\b")))
    )


def superseded_ids(references: Column) -> Column:
    """Identifiers in a list of sender,identifier,sent triples."""
    parts = F.transform(F.split(F.trim(F.coalesce(references, F.lit(""))), r"\s+"), lambda t: F.split(t, ","))
    return F.transform(F.filter(parts, lambda p: F.size(p) >= 2), lambda p: F.element_at(p, 2))


def still_valid(expires: Column, now: Column) -> Column:
    """True unless the expiry is a readable time in the past."""
    return F.coalesce(F.try_to_timestamp(F.nullif(expires, F.lit(""))) > now, F.lit(True))


def locality_label(town: Column, town_km: Column, district: Column, state: str) -> Column:
    """Nearest town within 25 km, else the district, else the state."""
    return F.when(town_km <= 25, town).when(district.isNotNull(), F.concat(district, F.lit(" district"))).otherwise(F.lit(state))
