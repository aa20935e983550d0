"""Expectations that are given from outside, for the rules that read utterances: what each sentence must come out as."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import understand as u
from loomwork.functions.checks import weak_signal

#: Sentence, action, what the item, the quantity and the place hold, way, status, next action.
SHOPPING = [
    ("Mepɛ sɛ metɔ tomatoes ma stew.", "buy", "tomatoes", None, None, None, "needs_clarification", "ask_quantity"),
    ("Hwehwɛ tomatoes a ɛbɛn Madina ma me.", "find", "tomatoes", None, "Madina", None, "ready_for_search", "search_local_catalog"),
    ("Mepɛ sɛ metɔ tomato 2 kg, fa brɛ me wɔ Adenta.", "buy", "tomato", "2 kg", "Adenta", "delivery", "ready_for_order_draft", "draft_order"),
    ("Can you order tomatoes for me online?", "order", "tomatoes", None, None, None, "needs_clarification", "ask_quantity"),
    ("How much is a bag of rice near East Legon?", "price", "bag of rice", None, "East Legon", None, "ready_for_search", "search_local_catalog"),
]
#: Action, item, quantity, place, way, status, next action.
PLANS = [
    ("buy", None, None, None, "unknown", "needs_clarification", "ask_item"),
    ("buy", "tomatoes", None, None, "unknown", "needs_clarification", "ask_quantity"),
    ("find", "tomatoes", None, "Madina", "unknown", "ready_for_search", "search_local_catalog"),
    ("order", "tomato", "2 kg", "Adenta", "delivery", "ready_for_order_draft", "draft_order"),
]
#: Sentence, severity, escalated, seconds, loudness, certainty, status, next action, urgency.
HEALTH = [
    ("Me nyinsɛn na me ti yɛ me yaw paa, m'anim nso ahonhon.", "EMERGENCY", True, 4.1, 0.06, 0.92, "urgent_referral", "recommend_urgent_care", "emergency"),
    ("ɛɛ me... yare no... hmm", "LOW", False, 1.1, 0.012, 0.36, "needs_clarification", "ask_clarifying_question", "routine"),
    ("mani kum paa", "MEDIUM", False, 2.2, 0.05, 0.9, "clinic_recommended", "recommend_clinic", "soon"),
    ("yɛsɛ yɛhospital bɛn na menkɔ", "MEDIUM", False, 2.5, 0.05, 0.91, "clinic_recommended", "recommend_clinic", "soon"),
    ("3y3 serius paa", "HIGH", True, 2.1, 0.05, 0.88, "clinic_recommended", "recommend_clinic", "urgent"),
    ("My father has crushing chest pain", "EMERGENCY", True, None, None, None, "urgent_referral", "recommend_urgent_care", "emergency"),
    ("ɛɛ me hmm", "LOW", False, 1.1, 0.012, 0.36, "needs_clarification", "ask_clarifying_question", "routine"),
    ("I have mild headache", "LOW", False, 3.2, 0.05, 0.9, "self_care", "give_general_guidance", "routine"),
]
#: Sentences with a sign that needs a hospital now, and without.
DANGER = {"Me nyinsɛn na me ti yɛ me yaw paa, m'anim nso ahonhon.": True, "My father has crushing chest pain": True, "mani kum paa": False, "I have mild headache": False, "My child has fever and chills since last night.": False}


def test_shopping(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(SHOPPING)], "i int, said string")
    said = F.col("said")
    parts = df.withColumns({"act": u.action(said), "thing": u.item(said), "amount": u.quantity(said), "place": u.location(said), "way": u.fulfilment(said)})
    whole = u.commerce_plan(u.action(said), u.item(said), u.quantity(said), u.location(said), u.fulfilment(said))
    for r in parts.withColumn("plan", whole).collect():
        _, act, thing, amount, place, way, status, do = SHOPPING[r.i]
        assert r.act == act and (r.plan.status, r.plan.next_action) == (status, do), r
        for got, want in ((r.thing, thing), (r.amount, amount), (r.place, place), (r.way, way)):
            assert want is None or want in got, r


def test_plans(spark):
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(PLANS)], "i int, act string, thing string, amount string, place string, way string")
    plan = u.commerce_plan(*(F.col(c) for c in ("act", "thing", "amount", "place", "way")))
    assert {r.i: (r.p.status, r.p.next_action) for r in df.select("i", plan.alias("p")).collect()} == {i: r[5:] for i, r in enumerate(PLANS)}


def test_health(spark):
    df = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(HEALTH)], "i int, said string, severity string, escalate boolean, seconds double, rms double, sure double")
    plan = u.health_plan(*(F.col(c) for c in ("said", "severity", "escalate", "seconds", "rms", "sure")))
    assert {r.i: tuple(r.p) for r in df.select("i", plan.alias("p")).collect()} == {i: r[6:] for i, r in enumerate(HEALTH)}
    weak = df.select("i", weak_signal(F.col("seconds"), F.col("rms"), F.col("sure"), F.col("said")).alias("w")).collect()
    assert {r.i for r in weak if r.w} == {i for i, r in enumerate(HEALTH) if r[6] == "needs_clarification"}


def test_danger(spark):
    df = spark.createDataFrame([(x,) for x in DANGER], "said string")
    assert {r.said: r.d for r in df.select("said", u.danger(F.col("said")).alias("d")).collect()} == DANGER
    urgent = u.safety_override(F.col("said"), F.lit("Rest well."), F.lit("HEALTH"), F.lit("LOW"), F.lit(False), F.lit(True))
    for r in df.select("said", urgent.alias("o")).collect():
        assert (r.o.severity == "EMERGENCY") == DANGER[r.said] and r.o.reply.endswith("Rest well.") and (r.o.reply == "Rest well.") != DANGER[r.said]
