"""Understanding of utterances. The driver's conversations say nothing of health or shops, so each turn's whole text gets one of a few
sentences in front, by its numbers, and every rule has cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.core import Tables, query
from loomwork.functions import understand as u

SENTENCES = (
    "How much is tomato paste near Kumasi market?",
    "Do you have oral rehydration salts in stock",
    "Is paracetamol available today",
    "I want to buy 2 kg rice for me in Accra, deliver please",
    "Order three bags of cement at Tema",
    "mepɛ sɛ metɔ mako wɔ Makola",
    "I am pregnant and have a severe headache",
    "nyinsen ne mogya bleeding",
    "there is chest pain since morning",
    "I can't breathe well",
    "me ho 3y3 y3 serius  fever",
    "me yafunu yɛ me yaw, ti yaw me den",
    "find soap near Kejetia pls",
    "thank you, could you repeat",
    "checkout my cart with pickup",
    "Search for mosquito net around Osu tomorrow",
    "the PRICE of rice in Kumasi",
    "hwehwɛ aduro bɛn Accra",
    "hmm mm",
    "get mmienu kilo tomato, fa brɛ me",
    "the phone is noisy in the field",
)
LANGUAGES, FOCUS = ("tw", "en", "ga"), ("health", "commerce")


def utterances(t: Tables) -> DataFrame:
    n = F.col("conv_id") * 7 + F.col("turn")
    pick = lambda values, number: F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))
    return t.spread(t.conversations).select("conv_id", "turn", F.concat_ws(" ", pick(SENTENCES, n), "text").alias("said"), pick(LANGUAGES, F.col("turn")).alias("language"), pick(FOCUS, F.col("conv_id")).alias("focus"))


def _pick(values, number: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[CAST(({number}) % {len(values)} AS INTEGER) + 1]"


SAID = f"WITH s AS (SELECT conv_id, turn, concat_ws(' ', {_pick(SENTENCES, 'conv_id * 7 + turn')}, text) AS said, {_pick(LANGUAGES, 'turn')} AS language, {_pick(FOCUS, 'conv_id')} AS focus FROM conversations) "


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(text: str, pattern: str, any_case: bool = False) -> str:
    return f"regexp_matches({text}, {_q(('(?i)' if any_case else '') + pattern)})"


def _first(text: str, rules, default: str, any_case: bool = False) -> str:
    return "CASE " + " ".join(f"WHEN {_has(text, p, any_case)} THEN '{label}'" for label, p in rules) + f" ELSE '{default}' END"


def _slot(value: str) -> str:
    clean = rf"trim(regexp_replace(regexp_replace({value}, {_q('(?i)' + u.FILLERS)}, ' ', 'g'), '\s+', ' ', 'g'))"
    return f"CASE WHEN length({clean}) >= 2 THEN substr({clean}, 1, 80) END"


def _first_slot(text: str, patterns) -> str:
    return "COALESCE(" + ", ".join(_slot(f"regexp_extract({text}, {_q('(?i)' + p)}, 1)") for p in patterns) + ")"


NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(said), '\b3y3\b', 'ɛyɛ', 'g'), '\by3\b', 'yɛ', 'g'), '\bserius\b', 'serious', 'g'), '\s+', ' ', 'g'))"
DANGER = f"(({_has(NORMAL, u.PREGNANCY)} AND ({_has(NORMAL, u.HEADACHE)} OR {_has(NORMAL, u.SWELLING)} OR {_has(NORMAL, u.BLEEDING)})) OR {_has(NORMAL, u.CHEST)} OR {_has(NORMAL, u.BREATHING)})"
INTENT = f"({_has('lower(said)', u.COMMERCE_EN)} OR {_has('lower(said)', u.COMMERCE_TW)})"
ACTION = _first("lower(said)", u.ACTIONS, "unknown")
WAY = _first("said", u.FULFILMENT, "unknown", True)
ITEM = _first_slot(r"trim(regexp_replace(regexp_replace(said, '[?.!,]', ' ', 'g'), '\s+', ' ', 'g'))", u.ITEMS)
AMOUNT, PLACE = _first_slot("said", u.QUANTITIES), _first_slot("said", u.LOCATIONS)
PARTS = f"p AS (SELECT *, {ACTION} AS act, {ITEM} AS thing, {AMOUNT} AS amount, {PLACE} AS place, {WAY} AS way FROM s) "
KEYS = "SELECT conv_id, turn, "


def _add(t: Tables, **columns) -> DataFrame:
    return utterances(t).select("conv_id", "turn", *(c.alias(n) for n, c in columns.items()))


@query("normalize_health", SAID + KEYS + NORMAL + " AS text FROM s")
def normalize_health(t: Tables) -> DataFrame:
    return _add(t, text=u.health_normal(F.col("said")))


@query("danger_flag", SAID + KEYS + DANGER + " AS danger FROM s")
def danger_flag(t: Tables) -> DataFrame:
    return _add(t, danger=u.danger(F.col("said")))


@query("commerce_intent", SAID + KEYS + INTENT + " AS shopping FROM s")
def commerce_intent(t: Tables) -> DataFrame:
    return _add(t, shopping=u.commerce_intent(F.col("said")))


@query("action_class", SAID + KEYS + ACTION + " AS action FROM s")
def action_class(t: Tables) -> DataFrame:
    return _add(t, action=u.action(F.col("said")))


@query("extract_item", SAID + KEYS + ITEM + " AS item FROM s")
def extract_item(t: Tables) -> DataFrame:
    return _add(t, item=u.item(F.col("said")))


@query("extract_quantity", SAID + KEYS + AMOUNT + " AS quantity FROM s")
def extract_quantity(t: Tables) -> DataFrame:
    return _add(t, quantity=u.quantity(F.col("said")))


@query("extract_location", SAID + KEYS + PLACE + " AS location FROM s")
def extract_location(t: Tables) -> DataFrame:
    return _add(t, location=u.location(F.col("said")))


@query(
    "slot_confidence",
    SAID
    + ", "
    + PARTS
    + KEYS
    + """way AS fulfilment, least(0.92::DOUBLE, floor((0.35::DOUBLE + CASE WHEN act <> 'unknown' THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN thing IS NOT NULL THEN 0.28::DOUBLE ELSE 0 END + CASE WHEN amount IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END
 + CASE WHEN place IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN way <> 'unknown' THEN 0.03::DOUBLE ELSE 0 END) * 100 + 0.5) / 100) AS confidence FROM p""",
)
def slot_confidence(t: Tables) -> DataFrame:
    return _add(t, fulfilment=u.fulfilment(F.col("said")), confidence=u.confidence(F.col("said")))


_MEMORY = ", ".join(f"(CASE WHEN length(trim(regexp_replace(regexp_extract(lower(said), {_q('(?i)' + p)}, 1), {_q(u.MEMORY_FILLERS)}, '', 'g'))) > 1 THEN substr(trim(regexp_replace(regexp_extract(lower(said), {_q('(?i)' + p)}, 1), {_q(u.MEMORY_FILLERS)}, '', 'g')), 1, 48) END)" for p in u.MEMORY_ITEMS)


@query("memory_candidates", SAID + KEYS + f"COALESCE({_MEMORY}) AS item, substr(nullif(trim(regexp_extract(lower(said), {_q('(?i)' + u.MEMORY_PLACE)}, 1)), ''), 1, 48) AS place FROM s")
def memory_candidates(t: Tables) -> DataFrame:
    return _add(t, item=u.memory_item(F.col("said")), place=u.memory_place(F.col("said")))


SEVERITIES = ("LOW", "MEDIUM", "HIGH", "EMERGENCY")
_SEVERITY = _pick(SEVERITIES, "conv_id + turn")


def _severity():
    return F.get(F.array(*map(F.lit, SEVERITIES)), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))


@query(
    "intent_override",
    SAID + f", v AS (SELECT *, {_SEVERITY} AS severity, focus = 'commerce' AND {INTENT} AS shop FROM s) " + KEYS
    + "CASE WHEN shop THEN 'ECOMMERCE' ELSE 'GENERAL' END AS intent, CASE WHEN shop AND severity <> 'EMERGENCY' THEN 'LOW' ELSE severity END AS severity, CASE WHEN shop AND severity <> 'EMERGENCY' THEN FALSE ELSE turn % 2 = 0 END AS escalate FROM v",
)
def intent_override(t: Tables) -> DataFrame:
    rows = utterances(t).withColumn("o", u.intent_override(F.col("said"), F.col("focus"), F.lit("GENERAL"), _severity(), F.col("turn") % 2 == 0))
    return rows.select("conv_id", "turn", "o.intent", "o.severity", "o.escalate")


@query(
    "safety_override",
    SAID
    + f", v AS (SELECT *, focus = 'health' AND {DANGER} AS urgent, CASE WHEN language = 'en' THEN {_q(u.URGENT_EN.format(u.HOTLINE))} ELSE {_q(u.URGENT_TW.format(u.HOTLINE))} END AS prefix FROM s) "
    + KEYS
    + "CASE WHEN urgent THEN 'EMERGENCY' ELSE 'LOW' END AS severity, CASE WHEN urgent THEN prefix || 'Rest well.' ELSE 'Rest well.' END AS reply FROM v",
)
def safety_override(t: Tables) -> DataFrame:
    once = u.safety_override(F.col("said"), F.lit("Rest well."), F.when(F.col("focus") == "health", "HEALTH").otherwise("ECOMMERCE"), F.lit("LOW"), F.lit(False), F.col("language") == "en")
    return utterances(t).withColumn("o", once).select("conv_id", "turn", "o.severity", "o.reply")


@query(
    "health_plan",
    """
WITH v AS (SELECT event_id, value / 100 < 1.4 OR (value / 10000 > 0 AND value / 10000 < 0.015) AS weak, event_type FROM events)
SELECT event_id, CASE WHEN weak THEN 'needs_clarification' WHEN event_type = 'error' THEN 'urgent_referral' WHEN event_type IN ('purchase', 'view') THEN 'clinic_recommended' ELSE 'self_care' END AS status,
 CASE WHEN weak THEN 'routine' WHEN event_type = 'error' THEN 'emergency' WHEN event_type = 'purchase' THEN 'urgent' WHEN event_type = 'view' THEN 'soon' ELSE 'routine' END AS urgency FROM v
""",
)
def health_plan(t: Tables) -> DataFrame:
    """Event types stand for severities, the value for length and loudness."""
    severity = F.when(F.col("event_type") == "error", "EMERGENCY").when(F.col("event_type") == "purchase", "HIGH").when(F.col("event_type") == "view", "MEDIUM").otherwise("LOW")
    plan = u.health_plan(F.lit("I have a fever"), severity, F.lit(False), F.col("value") / 100, F.col("value") / 10000, F.lit(None).cast("double"))
    return t.events.withColumn("plan", plan).select("event_id", "plan.status", "plan.urgency")


@query(
    "commerce_plan",
    SAID
    + ", "
    + PARTS
    + """, m AS (SELECT *, CASE WHEN act IN ('buy', 'order') THEN concat_ws(',', CASE WHEN amount IS NULL THEN 'quantity' END, CASE WHEN way = 'delivery' AND place IS NULL THEN 'location' END) ELSE '' END AS lacks FROM p)
SELECT conv_id, turn, CASE WHEN thing IS NULL OR lacks <> '' THEN 'needs_clarification' WHEN act IN ('price', 'availability', 'find') THEN 'ready_for_search' WHEN act IN ('buy', 'order') THEN 'ready_for_order_draft' ELSE 'unsupported' END AS status,
 CASE WHEN thing IS NULL THEN 'ask_item' WHEN lacks LIKE 'quantity%' THEN 'ask_quantity' WHEN lacks <> '' THEN 'ask_location' WHEN act IN ('price', 'availability', 'find') THEN 'search_local_catalog' WHEN act IN ('buy', 'order') THEN 'draft_order' ELSE 'explain_not_connected' END AS next_action,
 CASE WHEN thing IS NULL THEN 'item' ELSE lacks END AS missing FROM m""",
)
def commerce_plan(t: Tables) -> DataFrame:
    said = F.col("said")
    plan = u.commerce_plan(u.action(said), u.item(said), u.quantity(said), u.location(said), u.fulfilment(said))
    return utterances(t).withColumn("plan", plan).select("conv_id", "turn", "plan.status", "plan.next_action", F.array_join("plan.missing", ",").alias("missing"))


@query(
    "bucket_classify",
    SAID + KEYS
    + f"CASE WHEN {_has('said', u.NOISE, True)} THEN 'phone_noise' WHEN language = 'en' THEN 'health_en' WHEN language = 'tw' AND {_has('said', u.ENGLISH, True)} THEN 'codeswitch_tw_en' WHEN focus = 'commerce' THEN 'commerce_twi' ELSE 'health_twi' END AS bucket FROM s",
)
def bucket_classify(t: Tables) -> DataFrame:
    return _add(t, bucket=u.bucket(F.col("said"), F.lit(None).cast("string"), F.col("language"), F.col("focus")))


@query("language_class", SAID + KEYS + f"CASE WHEN language IN ('en', 'ga') THEN language WHEN {_has('said', u.ENGLISH, True)} THEN 'tw-en' ELSE 'tw' END AS language FROM s")
def language_class(t: Tables) -> DataFrame:
    return _add(t, language=u.language_class(F.col("said"), F.col("language")))


@query(
    "tag_array",
    SAID + KEYS
    + "COALESCE(nullif(concat_ws(',', CASE WHEN focus = 'commerce' THEN 'shopping' END, "
    + ", ".join(f"CASE WHEN {_has('said', p, True)} THEN '{tag}' END" for tag, p in u.TAGS)
    + "), ''), 'health') AS tags FROM s",
)
def tag_array(t: Tables) -> DataFrame:
    return _add(t, tags=F.array_join(u.domain_tags(F.col("said"), F.col("focus")), ","))


@query("clarifying_flag", SAID + KEYS + "contains(said, '?') OR " + " OR ".join(f"contains(lower(said), '{w}')" for w in u.CLARIFYING) + " AS clarifies FROM s")
def clarifying_flag(t: Tables) -> DataFrame:
    return _add(t, clarifies=u.clarifying(F.col("said")))


@query("title_and_terms", r"SELECT conv_id, turn, substr(text, 1, 60) AS title, array_to_string(list_slice(string_split_regex(text, '[\s,]+'), 1, 12), '|') AS terms FROM conversations")
def title_and_terms(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.substring("text", 1, 60).alias("title"), F.array_join(F.slice(F.split("text", r"[\s,]+"), 1, 12), "|").alias("terms"))
