import pytest

from pulsegrid.llm.pairs import flag_pairs, main_defects

P = "Assign one class to this recording. Options: 0=normal, 1=infection. Reply with a JSON object holding label and confidence.\nHR: median=84.2 spread=2.47 wave=[85.2, 84.6, 83.9, 85.2]\nTemp: ABSENT"
DE = "Ordne dieser Aufzeichnung genau eine Klasse zu. Auswahl: 0=normal, 1=infection. Antworte mit einem JSON-Objekt und mit nichts sonst.\nHR: median=84.2"
CASES = [
    (P, None, "empty"), (P, "", "empty"), (P, " ​\xa0\n", "empty"), (P, "-", "empty"), (P, "N/A", "empty"), (P, "null", "empty"),
    (P, "{ }", "empty"), (P, "[]", "empty"), (P, '""', "empty"), (P, "```json\n```", "empty"), (P, "```\n\n```", "empty"), (P, "…", "empty"),
    (P, '{"label": null, "confidence": null}', "empty"), (P, '{"label": "", "confidence": "", "rationale": ""}', "empty"),
    (P, '{"label": 0, "confidence": 0.0}', None),
    (P, P, "copy"), (P, P.upper(), "copy"), (P, "Question: " + P, "copy"), (P, '{"rationale": "' + P.replace("\n", " ") + '"}', "copy"), (P, P[40:], "copy"),
    (P, "I'm sorry, but I can't help with classifying patient recordings.", "refusal"),
    (P, '{"label": null, "confidence": 0.0, "rationale": "I must decline to label this recording."}', "refusal"),
    (DE, "Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"), (P, "Lo siento, pero no puedo ayudar con esta solicitud.", "refusal"),
    (P, '{"label": 1, "confidence": 0.8, "rationale": "I cannot rule out an early infection."}', None),
    (P, '{"label": 1, "confidence": 0.8, "rationale": "Sorry for the noisy lead, the other channels still agree."}', None),
    (P, '{"label": 1, "confidence": 0.', "truncated"), (P, '{"label": 1, "rationale": "The heart', "truncated"), (P, '```json\n{"label": 1}', "truncated"),
    (P, "Looking at the digest step by step. Breathing is close to 20 per", "truncated"), (P, "Label: 1, confidence 0.8. The heart rate stays", "truncated"),
    (P, "Looking at the digest step by step. The heart rate stays near 20.", "truncated"),
    (P, '"label": 1, "confidence": 0.8', None), (P, "Label: 1, confidence 0.8.", None), (P, 'Sure: {"label": 1} Let me know if more is needed.', None), (P, '{"label": "infection", "rationale": "which leaves few doubts..."}', None),
    (P, '{"label": 1, "rationale": "La presión está cerca de 100 y no destaca nada más, así que esta clase es la mejor."}', "other_language"),
    (P, "Пульс почти весь час держится около 91. Label: 1, 0.34", "other_language"),
    (DE, '{"label": 1, "rationale": "The heart rate stays near 84 for most of the hour and nothing else stands out."}', "other_language"),
    (DE, '{"label": 1, "rationale": "Die Herzfrequenz bleibt die meiste Zeit bei etwa 84 und sonst fällt nichts weiter auf."}', None),
    (P, '{"label": 1, "rationale": "There is a slow drift in the pulse (sinus rhythm, status quo, nil per os)."}', None),
    (None, '{"label": 1}', None), ("", "Label: 1.", None), (P, '{"label": 1, "rationale": "' + "the rate is steady and " * 20000 + 'fine."}', None),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, p, r, "old", 1) for i, (p, r, _) in enumerate(CASES)], "id int, prompt string, response string, defect string, defects int")
    return {r["id"]: r for r in flag_pairs(df).collect()}, {r["id"]: r["defect"] for r in main_defects(flag_pairs(df), "id").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    assert found[0][i]["defect"] == CASES[i][2], (CASES[i][1] or "")[:200]
    assert found[1].get(i) == CASES[i][2]


def test_empty_table_and_all_types(spark):
    df = spark.createDataFrame([(1, P, P + " {")], "id int, prompt string, response string")
    assert flag_pairs(df).first()["defects"] == ["copy", "truncated"]
    assert flag_pairs(df.limit(0)).count() == 0


Q = "What is the capital of France?"
PROBES = [
    (Q, "Paris is the capital of France.", []),
    (Q, "Paris", []),
    (Q, "It is on the Seine, and its name", ["truncated"]),
    (P, "I would rather not classify this window, sorry.", ["refusal"]),
    (P, "I can’t help with that.", ["refusal"]),
    (P, "I'm unable to provide a label for this recording.", ["refusal"]),
    (DE, "Das möchte ich lieber nicht entscheiden.", ["refusal"]),
    (P, "申し訳ありませんが、この記録を分類することはできません。", ["refusal", "other_language"]),
    (P, 'Sorry, I cannot answer this. {"label": 0, "confidence": 0.0}', ["refusal"]),
    (P, '{"label": 2, "rationale": "I cannot give a higher confidence here, as the lead is noisy."}', []),
    (P, "Jeg beklager, men jeg kan ikke hjelpe med dette.", ["refusal", "other_language"]),
    (P, '{"label": 1, "rationale": "Hjertefrekvensen holder seg rundt 84 det meste av timen, og ingenting annet skiller seg ut."}', ["other_language"]),
    (P, '{"label": 1, "rationale": "心拍数はほぼ一時間を通して安定しています。"}', ["other_language"]),
    (P, '{"label": 1, "rationale": "Ο παλμός μένει σταθερός."}', ["other_language"]),
    ("この記録を分類してください。", '{"label": 1, "rationale": "心拍数は安定しています。"}', []),
    ("Я прошу выбрать один класс для этой записи.", "Пульс почти не меняется.", []),
    (P, "Es tut mir leid, aber das kann ich nicht beurt", ["refusal", "truncated", "other_language"]),
    (P, P[:120] + " {", ["copy", "truncated"]),
]


def test_probes(spark):
    df = spark.createDataFrame([(i, p, r) for i, (p, r, _) in enumerate(PROBES)], "id int, prompt string, response string")
    got = {r["id"]: r["defects"] for r in flag_pairs(df).collect()}
    assert [(PROBES[i][1], got[i]) for i in range(len(PROBES))] == [(r, want) for _, r, want in PROBES]


def test_words_are_counted_once_and_marks_do_not_stick():
    import pyarrow as pa

    from pulsegrid.llm.pairs import _CODES, language_hits, repeated_hits

    texts = pa.array(["the “the” and… of", "", "l’heure est passée — et les autres", "x", "and of the 5 / 6", None])
    got = language_hits(texts)
    assert got[:, _CODES.index("en")].tolist() == [3, 0, 0, 0, 3, 0] and got[2, _CODES.index("fr")] == 4
    assert (repeated_hits(texts.fill_null("")) == got).all() and language_hits(texts.slice(2, 2)).tolist() == got[2:4].tolist()
