"""Rules that read intent, danger signs, slots and plans from an utterance, as columns.

Patterns are written with \\b for a word boundary between ASCII word characters; edged() spells that out for Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.checks import EDGE, weak_signal
from loomwork.functions.text import once

#: The patterns of danger signs, intents, actions, slots and buckets.
PREGNANCY = r"\b(pregnan|nyinsɛn|nyinsen|yafunu)\b"
HEADACHE = r"\b(severe headache|bad headache|ti yɛ me yaw paa|ti yaw.*den|ti yare.*den)\b"
SWELLING = r"\b(swelling|swollen|ahonhon|anim.*hon|nsa.*hon)\b"
BLEEDING = r"\b(bleeding|mogya|blood)\b"
CHEST = r"\b(chest pain|crushing chest|kokom.*yaw)\b"
BREATHING = r"\b(can'?t breathe|breathing trouble|home.*den|ahome.*den)\b"
COMMERCE_EN = r"\b(buy|order|shop|shopping|market|cart|checkout|price|cost|delivery|pickup|store|stores|available|availability|find|get)\b"
COMMERCE_TW = r"\b(mepɛ|me pɛ|metɔ|me tɔ|mɛtɔ|mebɛtɔ|atɔ|tɔ|boɔ|bo|dwa|market|hwehwɛ|hwehwɛɛ|kra|fa brɛ|brɛ me)\b"
ACTIONS = (
    ("price", r"\b(price|cost|how much|boɔ|bo)\b"),
    ("availability", r"\b(available|availability|in stock|do you have)\b"),
    ("find", r"\b(find|search|hwehwɛ|hwehwɛɛ|near|bɛn)\b"),
    ("order", r"\b(order|checkout|kra)\b"),
    ("buy", r"\b(buy|get|shop|metɔ|me tɔ|mɛtɔ|mebɛtɔ|atɔ|tɔ)\b"),
    ("buy", r"(?:me|mɛ|mebɛ|mepɛ sɛ)\s*tɔ"),
)
FULFILMENT = (("delivery", r"\b(deliver|delivery|fa brɛ|brɛ me|bring|send)\b"), ("pickup", r"\b(pickup|pick up|come for|meba|mɛba)\b"))
ITEMS = (
    r"\bhow much is\s+(.+?)(?:\s+(?:near|around|in|at|for)\b|$)",
    r"\bdo you have\s+(.+?)(?:\s+(?:near|around|in|at|for|in the market|available)\b|$)",
    r"\bis\s+(.+?)\s+available\b",
    r"\b(?:price|cost|boɔ|bo)\s+(?:of|for)?\s*(.+?)(?:\s+(?:near|around|in|at|for)\b|$)",
    r"\b(?:buy|order|get|find|search for)\s+(.+?)(?:\s+(?:for me|online|near|around|in|at|to|for|ma me|ma|wɔ|wo|a ɛbɛn|bɛn)\b|$)",
    r"\b(?:metɔ|me tɔ|mɛtɔ|mebɛtɔ|mepɛ sɛ metɔ|mepɛ sɛ me tɔ|mepɛ|me pɛ|hwehwɛ)\s+(.+?)(?:\s+(?:ma me|ma|wɔ|wo|a ɛbɛn|bɛn|online|near|around|for)\b|$)",
)
UNITS = r"kg|kilo|kilos|crate|crates|bag|bags|pack|packs|pieces?|bunch(?:es)?|dozen|litres?|l|sachet(?:s)?"
QUANTITIES = (
    rf"\b(\d+\s*(?:{UNITS}))\b",
    rf"\b((?:one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:{UNITS}))\b",
    r"\b((?:baako|mmienu|mmiɛnsa|anan|anum|nsia|nson|nwɔtwe|nkron|du)\s+(?:kilo|bag|pack|pieces?|bunch|crate))\b",
)
LOCATIONS = (r"\b(?:near|around|in|at)\s+([a-zA-ZɛɔƐƆŋŊ][\wɛɔƐƆŋŊ -]{2,40})", r"\b(?:wɔ|wo|bɛn|a ɛbɛn)\s+([a-zA-ZɛɔƐƆŋŊ][\wɛɔƐƆŋŊ -]{2,40})")
FILLERS = r"\b(please|pls|ma me|for me|online|today|tomorrow|nnɛ|kyena)\b"
MEMORY_ITEMS = (r"\b(?:buy|order|get|find)\s+([a-zɛɔŋ][\wɛɔŋ -]{1,40})", r"\b(?:metɔ|mɛtɔ|me tɔ|mepɛ|me pɛ|mɛpɛ)\s+([a-zɛɔŋ][\wɛɔŋ -]{1,40})")
MEMORY_PLACE = r"\b(?:at|in|near|around|wɔ|wo)\s+([a-zɛɔŋ][\wɛɔŋ -]{2,40})"
MEMORY_FILLERS = r"\b(no|bi|please|pls)\b"
ENGLISH = r"\b(the|and|pain|fever|buy|order|price|tomato|medicine|delivery|stomach|headache)\b"
NOISE = r"phone|noise|noisy|mobile|field"
TAGS = (("fever", r"fever|hyew|temperature|malaria"), ("symptom", r"pain|ya|headache|stomach|yam"), ("medicine", r"medicine|paracetamol|drug|aduro"), ("commerce", r"tomato|mako|rice|soap|buy|order|price|t[oɔ]"))
URGENT_EN = "This may be urgent. Please go to a hospital now or call {}. "
URGENT_TW = "Eyi betumi ayɛ emergency. Kɔ hospital ntɛm anaa frɛ {}. "
HOTLINE = "112 or your nearest clinic / community health worker"
CLARIFYING = ("repeat", "clarify", "bio", "san ka", "mente", "wopɛ sɛ")


def edged(pattern: str, any_case: bool = False) -> str:
    return ("(?iu)" if any_case else "") + pattern.replace(r"\b", EDGE)


def has(text: Column, pattern: str, any_case: bool = False) -> Column:
    return text.rlike(edged(pattern, any_case))


def first_rule(text: Column, rules, default: str, any_case: bool = False) -> Column:
    """The label of the first rule whose pattern the text has."""
    out = F
    for label, pattern in rules:
        out = out.when(has(text, pattern, any_case), label)
    return out.otherwise(default)


def health_normal(text: Column) -> Column:
    t = F.lower(text)
    for pattern, to in ((r"\b3y3\b", "ɛyɛ"), (r"\by3\b", "yɛ"), (r"\bserius\b", "serious"), (r"\s+", " ")):
        t = F.regexp_replace(t, edged(pattern), to)
    return F.trim(t)


def danger(text: Column) -> Column:
    """Signs that need a hospital now. (As stated, a boundary must follow `pregnan`, so `pregnant` isn't one.)"""
    t = health_normal(text)
    return (has(t, PREGNANCY) & (has(t, HEADACHE) | has(t, SWELLING) | has(t, BLEEDING))) | has(t, CHEST) | has(t, BREATHING)


def commerce_intent(text: Column) -> Column:
    low = F.lower(text)
    return has(low, COMMERCE_EN) | has(low, COMMERCE_TW)


def action(text: Column) -> Column:
    return first_rule(F.lower(text), ACTIONS, "unknown")


def fulfilment(text: Column) -> Column:
    return first_rule(text, FULFILMENT, "unknown", any_case=True)


def slot(value: Column) -> Column:
    """Without courtesies and times, squeezed, cut at 80; null if shorter than two characters."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(value, edged(FILLERS, True), " "), r"\s+", " "))
    return once(clean, lambda c: F.when(F.length(c) >= 2, F.substring(c, 1, 80)))


def first_slot(text: Column, patterns) -> Column:
    return F.coalesce(*(slot(F.regexp_extract(text, edged(p, True), 1)) for p in patterns))


def item(text: Column) -> Column:
    return once(F.trim(F.regexp_replace(F.regexp_replace(text, "[?.!,]", " "), r"\s+", " ")), lambda t: first_slot(t, ITEMS))


def quantity(text: Column) -> Column:
    return first_slot(text, QUANTITIES)


def location(text: Column) -> Column:
    return first_slot(text, LOCATIONS)


def confidence(text: Column) -> Column:
    points = lambda c, p: F.when(c, p).otherwise(0.0)
    total = F.lit(0.35) + points(action(text) != "unknown", 0.18) + points(item(text).isNotNull(), 0.28) + points(quantity(text).isNotNull(), 0.08) + points(location(text).isNotNull(), 0.08) + points(fulfilment(text) != "unknown", 0.03)
    return F.least(F.lit(0.92), F.floor(total * 100 + 0.5) / 100)


def memory_item(text: Column) -> Column:
    found = [F.trim(F.regexp_replace(F.regexp_extract(F.lower(text), edged(p, True), 1), edged(MEMORY_FILLERS), "")) for p in MEMORY_ITEMS]
    return F.coalesce(*(once(x, lambda f: F.when(F.length(f) > 1, F.substring(f, 1, 48))) for x in found))


def memory_place(text: Column) -> Column:
    return once(F.trim(F.regexp_extract(F.lower(text), edged(MEMORY_PLACE, True), 1)), lambda found: F.when(found != "", F.substring(found, 1, 48)))


def intent_override(text: Column, focus: Column, intent: Column, severity: Column, escalate: Column) -> Column:
    """(intent, severity, escalate): shopping talk under a shopping focus is commerce, of low severity unless an emergency."""
    shop = (focus == "commerce") & commerce_intent(text)
    urgent = severity == "EMERGENCY"
    return F.struct(F.when(shop, "ECOMMERCE").otherwise(intent).alias("intent"), F.when(shop & ~urgent, "LOW").otherwise(severity).alias("severity"), F.when(shop & ~urgent, False).otherwise(escalate).alias("escalate"))


def safety_override(text: Column, reply: Column, intent: Column, severity: Column, escalate: Column, english: Column) -> Column:
    """(severity, escalate, reply): a danger sign in health talk is an emergency, and the reply says so, once."""
    urgent = (intent == "HEALTH") & danger(text)
    prefix = F.when(english, URGENT_EN.format(HOTLINE)).otherwise(URGENT_TW.format(HOTLINE))
    said = F.when(F.startswith(reply, prefix), reply).otherwise(F.concat(prefix, reply))
    return F.struct(F.when(urgent, "EMERGENCY").otherwise(severity).alias("severity"), urgent | escalate, F.when(urgent, said).otherwise(reply).alias("reply"))


def health_plan(text: Column, severity: Column, escalate: Column, seconds: Column, rms: Column, probability: Column) -> Column:
    """(status, next_action, urgency), in this order: weak signal, emergency, high or escalated, medium, else self-care."""
    plan = lambda *x: F.struct(*(F.lit(v).alias(n) for v, n in zip(x, ("status", "next_action", "urgency"), strict=True)))
    return (
        F.when(weak_signal(seconds, rms, probability, text), plan("needs_clarification", "ask_clarifying_question", "routine"))
        .when(severity == "EMERGENCY", plan("urgent_referral", "recommend_urgent_care", "emergency"))
        .when((severity == "HIGH") | escalate, plan("clinic_recommended", "recommend_clinic", "urgent"))
        .when(severity == "MEDIUM", plan("clinic_recommended", "recommend_clinic", "soon"))
        .otherwise(plan("self_care", "give_general_guidance", "routine"))
    )


def commerce_plan(act: Column, thing: Column, amount: Column, place: Column, way: Column) -> Column:
    """(status, next_action, missing): what to ask for, or what can be done. The five parts are made once."""
    parts = F.struct(act.alias("act"), thing.alias("thing"), amount.alias("amount"), place.alias("place"), way.alias("way"))
    return once(parts, lambda p: _commerce_plan(p["act"], p["thing"], p["amount"], p["place"], p["way"]))


def _commerce_plan(act: Column, thing: Column, amount: Column, place: Column, way: Column) -> Column:
    buying = act.isin("buy", "order")
    lacks = F.filter(F.array(F.when(buying & amount.isNull(), "quantity"), F.when(buying & (way == "delivery") & place.isNull(), "location")), lambda x: x.isNotNull())
    plan = lambda status, do, missing: F.struct(F.lit(status).alias("status"), do.alias("next_action"), missing.alias("missing"))
    none = F.array().cast("array<string>")
    return (
        F.when(thing.isNull(), plan("needs_clarification", F.lit("ask_item"), F.array(F.lit("item"))))
        .when(F.size(lacks) > 0, plan("needs_clarification", F.when(F.get(lacks, F.lit(0)) == "quantity", "ask_quantity").otherwise("ask_location"), lacks))
        .when(act.isin("price", "availability", "find"), plan("ready_for_search", F.lit("search_local_catalog"), none))
        .when(buying, plan("ready_for_order_draft", F.lit("draft_order"), none))
        .otherwise(plan("unsupported", F.lit("explain_not_connected"), none))
    )


def bucket(text: Column, notes: Column, language: Column, focus: Column) -> Column:
    """The evaluation bucket; noise words count wherever they stand."""
    whole = F.concat(text, F.lit(" "), F.coalesce(notes, F.lit("")))
    return (
        F.when(has(whole, NOISE, True), "phone_noise")
        .when(language == "en", "health_en")
        .when((language == "tw") & has(text, ENGLISH, True), "codeswitch_tw_en")
        .when(focus == "commerce", "commerce_twi")
        .otherwise("health_twi")
    )


def language_class(text: Column, language: Column) -> Column:
    return F.when(language == "en", "en").when(language == "ga", "ga").when(has(text, ENGLISH, True), "tw-en").otherwise("tw")


def domain_tags(text: Column, focus: Column) -> Column:
    """Tags in the order of their rules, or one that the focus gives."""
    found = F.array(F.when(focus == "commerce", "shopping"), *(F.when(has(text, p, True), tag) for tag, p in TAGS))
    some = F.array_distinct(F.filter(found, lambda x: x.isNotNull()))
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.when(focus == "commerce", "commerce").otherwise("health")))


def clarifying(reply: Column) -> Column:
    low = F.lower(reply)
    return reduce(lambda a, b: a | b, (low.contains(w) for w in CLARIFYING), reply.contains("?"))
