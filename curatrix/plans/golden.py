"""Functions on golden cases: the inputs stand in the query, the values that each must give in its SQL.

The driver's tables hold no clinical rows; these cases are the survey's, and others worked out by hand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions import audit, clinical, semi, text
from curatrix.operators import generated, match, rules, validate
from curatrix.plans.registry import Tables, add

_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "long": "BIGINT"}


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def golden(name: str, given: str, wanted: str, cases: Sequence[tuple], make: Callable[..., Sequence[Column]]) -> None:
    """Registers a query: `make` of the given columns must be the wanted ones. A case is (inputs..., outputs...)."""
    ins, outs = ([x.split(" ") for x in ddl.split(", ")] for ddl in (given, wanted))

    def run(t: Tables):
        rows = [(k, *case[: len(ins)]) for k, case in enumerate(cases)]
        made = make(*(F.col(n) for n, _ in ins))
        return t.spark.createDataFrame(rows, f"k long, {given}").select("k", *(c.cast(kind).alias(n) for c, (n, kind) in zip(made, outs, strict=True)))

    rows = ", ".join("(" + ", ".join(map(literal, (k, *case[len(ins) :]))) + ")" for k, case in enumerate(cases))
    add(name, f"SELECT CAST(k AS BIGINT) AS k, {', '.join(f'CAST({n} AS {_TYPES[kind]}) AS {n}' for n, kind in outs)} FROM (VALUES {rows}) v(k, {', '.join(n for n, _ in outs)})", run)


def told(c: Column) -> Column:
    return F.array_join(c, ";")


def fields(s: Column, *names: str) -> list[Column]:
    return [s[n] for n in names]


golden("renal_status", "said string", "status string, crcl double, egfr double", [
    ("Mild (CrCl 70 mL/min)", "mild", 70.0, None), ("None (eGFR > 90)", "normal", None, 90.0), ("Normal (eGFR 88), stable", "normal", None, 88.0), ("", "not reported", None, None), (None, "not reported", None, None),
    ("ESRD on hemodialysis", "kidney failure / dialysis", None, None), ("CrCl 45 mL/min", "moderate", 45.0, None), ("eGFR 12", "kidney failure / dialysis", None, 12.0), ("eGFR 29.5", "severe", None, 29.5), ("single kidney", "impaired (unspecified)", None, None),
    ("No acute distress; CrCl 25 mL/min severe CKD", "severe", 25.0, None), ("CrCl 95", "normal", 95.0, None), ("N/A", "not reported", None, None), ("denies", "normal", None, None),
], lambda c: fields(clinical.renal(c), "status", "crcl", "egfr"))

golden("hepatic_status", "said string", "status string, child_pugh string", [
    ("Severe (Child-Pugh C)", "severe", "C"), ("Child-Pugh B cirrhosis", "moderate", "B"), ("Child Pugh a", "mild", "A"), ("LFTs within normal limits", "normal", None), ("fatty liver", "mild", None),
    ("Chronic hepatitis", "impaired (unspecified)", None), ("None", "not reported", None), ("No known disease", "normal", None), ("decompensated", "severe", None), ("a nodule", "impaired (unspecified)", None),
], lambda c: fields(clinical.hepatic(c), "status", "child_pugh"))


def _heart(c):
    h = clinical.cardiac(c)
    return [h["present"], told(h["flags"]), h["qtc"], h["ef"], h["bp"]]


golden("cardiac_status", "said string", "present boolean, flags string, qtc double, ef double, bp string", [
    ("None (ECG normal, QTc < 440 ms)", False, "", 440.0, None, None), ("VT, EF 45%", True, "heart failure / reduced EF;ventricular arrhythmia", None, 45.0, None), ("Atrial fibrillation, rate-controlled", True, "atrial fibrillation", None, None, None),
    ("Prehypertension (126/82), lifestyle-managed", True, "hypertension", None, None, "126/82"), ("QTc 470 ms", True, "QT prolongation", 470.0, None, None), ("CAD with stent, EF 55", True, "coronary disease", None, 55.0, None),
    ("", False, "", None, None, None), ("AV block, HTN 150 / 95", True, "hypertension;bradycardia / conduction", None, None, "150/95"),
], _heart)


def _lung(c):
    r = clinical.respiratory(c)
    return [r["present"], told(r["flags"]), r["severe"]]


golden("respiratory_status", "said string", "present boolean, flags string, severe boolean", [
    ("No asthma or COPD", False, "asthma;COPD", False), ("Mild intermittent asthma, well-controlled", True, "asthma", False), ("Severe COPD on oxygen", True, "COPD", True), ("Allergic rhinitis", True, "rhinitis only", False),
    ("OSA, pulmonary fibrosis", True, "sleep apnea;interstitial lung disease", False), (None, False, "", False),
], _lung)

golden("pregnancy_status", "said string, sex string", "status string, trimester long, weeks double", [
    ("Pregnant (2nd trimester)", "Female", "pregnant", 2, None), ("Not pregnant / not breastfeeding", "Female", "not_applicable", None, None), ("Breastfeeding", "Female", "breastfeeding", None, None), ("", "Male", "not_applicable", None, None),
    ("", "Female", "not_reported", None, None), ("Pregnant, 30 weeks", "Female", "pregnant", 3, 30.0), ("trying to conceive", "f", "planning_pregnancy", None, None), (None, None, "not_reported", None, None),
], lambda c, s: fields(clinical.pregnancy(c, s), "status", "trimester", "weeks"))

golden("allergies_and_lists", "said string", "allergies string, items string", [
    ("NKDA", "", ""), ("Penicillin (rash, tolerates NSAIDs)", "Penicillin (rash, tolerates NSAIDs)", "Penicillin (rash, tolerates NSAIDs)"), ("Aspirin, metoprolol", "Aspirin;metoprolol", "Aspirin;metoprolol"),
    ("Warfarin 5 mg daily; tramadol 50 mg.", "Warfarin 5 mg daily;tramadol 50 mg", "Warfarin 5 mg daily;tramadol 50 mg"), ("No known allergies", "", ""), (None, "", ""), ("Sulfa; no known food allergies", "", "Sulfa;no known food allergies"),
], lambda c: [told(clinical.allergies(c)), told(clinical.listed(c))])

golden("tobacco_use", "said string", "level string, packs double, cigarettes double", [
    ("Former smoker, quit 12 years ago", "former", None, None), ("Never (nonsmoker)", "never", None, None), ("Current, 1 ppd", "current", 1.0, None), ("social smoker", "current_light", None, None), ("10 cigarettes per day", "current", None, 10.0),
    ("", "not_reported", None, None), ("something else", "unclear", None, None), ("Vape, 0.5 packs a day", "current", 0.5, None),
], lambda c: fields(clinical.tobacco(c), "level", "packs", "cigarettes"))

golden("alcohol_use", "said string", "level string, per_week double", [
    ("Occasional (1-2 drinks/week), none with medication", "light", 2.0), ("Former, sober 6 years", "former", None), ("3 drinks/day", "heavy", 21.0), ("8 units per week", "moderate", 8.0), ("No", "none", None), ("Never", "none", None),
    (None, "not_reported", None), ("Binge drinking", "heavy", None), ("see notes", "unclear", None), ("1 beer a night", "moderate", 7.0),
], lambda c: fields(clinical.alcohol(c), "level", "per_week"))

golden("substance_use", "said string", "level string, found string", [
    ("Former cocaine use, abstinent 9 years", "former", "cocaine"), ("Occasional cannabis use", "current", "cannabis"), ("denies", "none", ""), ("", "not_reported", ""), ("MDMA and ketamine", "current", "ketamine;mdma"), ("unsure", "unclear", ""),
], lambda c: [clinical.substances(c)["level"], told(clinical.substances(c)["found"])])

golden("caffeine_intake", "said string", "level string, cups double, energy boolean", [
    ("Moderate (1-2 cups coffee/day)", "moderate", 2.0, False), ("1 cup tea/day", "low", 1.0, False), ("5 cups coffee/day plus energy drinks", "high", 5.0, True), ("decaf only", "low", None, False), ("Red Bull", "high", None, True), (None, "not_reported", None, False),
    ("3 espressos", "moderate", 3.0, False), ("tea", "unclear", None, False),
], lambda c: fields(clinical.caffeine(c), "level", "cups", "energy"))

golden("dose_units", "said string", "amount double, unit string", [
    ("75 mcg daily", 0.075, "mg"), ("1 g twice daily", 1000.0, "mg"), ("10 units at bedtime", 10.0, "units"), ("5000 IU weekly", 5000.0, "iu"), ("5 mL every 6 hours", 5.0, "ml"), ("apply thinly", None, None), ("2.5 MG", 2.5, "mg"), ("250 µg", 0.25, "mg"),
], lambda c: [F.round(clinical.dose(c)["amount"], 6), clinical.dose(c)["unit"]])

golden("dose_frequency", "said string", "per_day double, as_needed boolean", [
    ("daily", 1.0, False), ("BID", 2.0, False), ("300 mg TID", 3.0, False), ("four times a day", 4.0, False), ("every 3 hours as needed", 8.0, True), ("q8-12h", 3.0, False), ("every other day", 0.5, False), ("once weekly", round(1 / 7, 6), False), ("twice weekly", round(2 / 7, 6), False),
    ("every fortnight", round(1 / 14, 6), False), ("monthly", round(1 / 30, 6), False), ("500 mg single dose", 1.0, False), ("STAT", 1.0, False), ("q4h prn", 6.0, True), ("5 mg", None, False), ("q5h", 4.8, False), ("at bedtime", 1.0, False),
], lambda c: [F.round(clinical.per_day(c), 6), clinical.as_needed(c)])

golden("dose_route", "said string", "route string", [
    ("5 mg PO", "oral"), ("IV over 1 h", "IV"), ("IM once", "IM"), ("subcutaneous", "SC"), ("apply cream", "topical/transdermal"), ("2 puffs", "inhaled"), ("suppository", "rectal"), ("under the tongue SL", "sublingual"), ("nasal spray", "nasal"), ("eye drops", "ophthalmic"), ("5 mg epidural", "neuraxial"), ("5 mg", None),
], lambda c: [clinical.route(c)])

golden("duration_classes", "said string", "duration string", [
    ("chronic (ongoing)", "chronic"), ("4 weeks", "intermediate_course"), ("5 days", "short_course"), ("As needed", "prn"), ("single dose", "single_dose"), ("6 months", "chronic"), ("", "not_reported"), ("until better", "unspecified"), ("14-day course", "short_course"), ("2 mos", "intermediate_course"),
], lambda c: [clinical.duration_class(c)])


def _rx(d, n, w, g):
    p = clinical.prescription(d, n, w, g)
    return [p["dose"], p["unit"], F.round(p["per_day"], 6), p["daily_mg"], p["mg_per_kg_day"], p["weight_based"], p["titration_mg"], p["route"], p["duration"]]


golden("prescription_block", "dosage string, duration string, weight double, drug string", "dose double, unit string, per_day double, daily_mg double, mg_per_kg_day double, weight_based boolean, titration_mg double, route string, duration string", [
    ("Warfarin 5 mg PO once daily", "chronic (ongoing)", 84.0, "Warfarin", 5.0, "mg", 1.0, 5.0, 0.0595, False, None, "oral", "chronic"), ("300 mg TID, titrating to 600 mg TID", "4 weeks", None, "Gabapentin", 300.0, "mg", 3.0, 900.0, None, False, 600.0, None, "intermediate_course"),
    ("15 mg PO every 8 hours (ER tablet)", "5 days", None, "Morphine", 15.0, "mg", 3.0, 45.0, None, False, None, "oral", "short_course"), ("0.2 mg/kg orally every 3 hours", None, 70.0, "Morphine", 14.0, "mg", 8.0, 112.0, 1.6, True, None, "oral", "not_reported"),
    ("0.2 mg/kg every 3 hours", "1 day", None, "x", None, "mg", 8.0, None, None, True, None, None, "short_course"), ("10 units daily", "long-term", 80.0, "Insulin SC", 10.0, "units", 1.0, None, None, False, None, "SC", "chronic"), (None, "", 1.0, None, None, None, None, None, None, False, None, None, "not_reported"),
], _rx)


def _vector(age, sex, w, h, kidneys, drugs, dose):
    f = {"age": age, "sex": sex, "weight": w, "height": h, "renal": kidneys, "medications": drugs, "dosage": dose, "duration": F.lit("2 weeks"), "drug": F.lit("oral X")}
    c = clinical.blocks(f, ("patient", "prescription"))
    p = c["patient"]
    return [p["age_band"], p["bmi"], p["bmi_class"], p["renal"]["status"], told(p["medications"]), p["pregnancy"]["status"], c["prescription"]["daily_mg"], c["prescription"]["route"], clinical.context(f)["prescription"]["mg_per_kg_day"]]


golden("patient_vector", "age string, sex string, weight string, height string, kidneys string, drugs string, dosage string", "age_band string, bmi double, bmi_class string, renal string, drugs_list string, pregnancy string, daily_mg double, route string, per_kg double", [
    ("72", "Male", "80", "180", "CrCl 45", "Aspirin; x", "5 mg BID", "older adult (65-79)", 24.7, "normal", "moderate", "Aspirin;x", "not_applicable", 10.0, "oral", 0.125), ("1", "Female", "10", "75", "", None, "1 mg", "infant (<2)", 17.8, "underweight", "not reported", "", "not_reported", None, "oral", None),
    ("x", None, "0", "180", "severe", "none", "", "unknown", None, "unknown", "severe", "", "not_reported", None, "oral", None),
], _vector)

golden("block_schema", "said string", "a double, items long, note string", [
    ('{"a": 1.5, "items": ["x", "y"], "z": 1}', 1.5, 2, "ok"), ('{"a": 2}', 2.0, 0, "missing_keys:1"), ("no", None, None, "parse_failed"), ("{}", None, 0, "missing_keys:2"),
], lambda c: [(b := clinical.coerced(c, "a double, items array<string>", ("items",)))["block"]["a"], F.when(b["block"].isNotNull(), F.size(b["block"]["items"])), b["note"]])

golden("age_and_body_bands", "age double, bmi double", "age_band string, bmi_class string", [
    (1.9, 18.4, "infant (<2)", "underweight"), (2.0, 18.5, "child (2-11)", "normal"), (12.0, 25.0, "adolescent (12-17)", "overweight"), (18.0, 30.0, "adult (18-64)", "obese class I"), (65.0, 35.0, "older adult (65-79)", "obese class II"), (80.0, 40.0, "very elderly (>=80)", "obese class III"), (None, None, "unknown", "unknown"),
], lambda a, b: [clinical.age_band(a), clinical.bmi_class(b)])

# Text functions.
golden("normal_cells", "said string", "norm string, truth boolean, number double, missing boolean", [
    ("  Yes ", "yes", True, None, False), ("UNSAFE", "unsafe", False, None, False), (" 3.50", "3.50", None, 3.5, False), ("N/A", "n/a", None, None, True), (None, "", None, None, True), ("0", "0", False, 0.0, False), ("perhaps", "perhaps", None, None, False),
], lambda c: [text.norm(c), text.to_bool(c), text.to_number(c), text.null_if(c).isNull()])

golden("fancy_dashes_found", "said string", "found string, folded string", [("a–b — c–d", "–;—", "a-b - c-d"), ("plain-hyphen", "", "plain-hyphen"), ("x−1", "−", "x-1")], lambda c: [told(text.fancy_dashes(c)), text.fold_dashes(c)])
golden("straight_punctuation", "said string", "plain string", [("“Don’t” – he said…", '"Don\'t" - he said.'), ("a b «c»", 'a b "c"'), ("plain", "plain")], lambda c: [text.straight_quotes(c)])
golden("header_unify", "said string", "unified string, first string", [
    ("intro\n**Risk audit:**\nx\n2. final VERDICT\ny", "intro\n## Audit\nx\n## Verdict\ny", "## Audit"), ("# Final verdict\nz", "## Verdict\nz", "## Verdict"), ("risk audit is here", "risk audit is here", None),
], lambda c: [(u := text.headers(c, {"risk audit": "## Audit", "final verdict": "## Verdict"})), text.first_header(u, ("## Audit", "## Verdict"))])
golden("list_items", "said string", "items string", [
    ("a, b; c", "a, b|c"), ("a (x, y), b", "a (x, y)|b"), ("None known", ""), ("nkda", ""), (" one ", "one"), ("a;; b", "a|b"), ("a, none", "a|none"),
], lambda c: [F.array_join(text.split_items(c), "|")])
golden("leaking_brackets", "said string", "plain string", [("Metformin (renal dosing) 500 mg (oral)", "Metformin 500 mg (oral)"), ("x (CrCl 30)", "x"), ("no brackets", "no brackets")], lambda c: [text.strip_brackets(c, ("renal", "crcl"))])
golden("blind_tokens", "said string", "held string", [("Is_Safe is TRUE; Reasoning", "Is_Safe;Reasoning"), ("a profile", ""), ("Risk_Categories", "Risk_Categories")], lambda c: [told(text.forbidden(c, ("Is_Safe", "Risk_Categories", "Reasoning")))])
golden("placeholders", "said string", "shown string, tokens double", [(" x ", "x", 0.75), ("None", "Not reported", 1.0), (None, "Not reported", None), ("nan", "Not reported", 0.75), ("two words", "two words", 2.25)], lambda c: [text.placeholder(c), text.approx_tokens(c)])
golden("percentages", "share double", "percent double", [(0.9135, 91.4), (0.12345, 12.3), (0.5, 50.0), (0.99949, 99.9), (0.00050001, 0.1), (0.0, 0.0)], lambda c: [text.percent(c)])
golden("demographic_leaks", "said string", "found string", [("A 45-year-old woman, 70 kg, BMI 24.5", "45-year-old;woman;70 kg;bmi 24.5"), ("The patient", ""), ("aged 12, male", "aged 12;male")], lambda c: [told(text.demographics(c))])
golden("sentences_dropped", "said string", "kept string, n long", [("One is. Two is not! Three?", "One is. Three?", 3), ("none here", "none here", 1), ("Not this. Not that.", "", 2)], lambda c: [text.drop_sentences(c, "(?i)not"), F.size(text.sentences(c))])
golden("tidy_texts", "said string", "tidied string, age string", [("a  b ,, c .. ", "a b, c.", "a  b ,, c .. "), ("72.0", "72.0", "72"), ("x ;;; y", "x; y", "x ;;; y")], lambda c: [text.tidy(c), text.whole_number(c)])
golden("word_flips", "said string", "flipped string, n long", [("x: true, y: false", "x: false, y: true", 4), ("untrue", "untrue", 1), ("", "", 0)], lambda c: [text.flip_word(c, "true", "false"), text.words(c)])
golden("bullet_fields", "said string", "age string, sex string, n long", [("- Age: 3\n- Sex: f\n- Age: 4", "3", "f", 2), ("* Sex:m", None, "m", 1), ("none", None, None, 0)], lambda c: [F.element_at(b := text.bullets(c), "Age"), F.element_at(b, "Sex"), F.size(b)])
golden("identity_keys", "a string, b string", "same boolean", [(" X  y", "x y", True), ("a", "b", False), (None, "", True)], lambda a, b: [text.identity_key(a, F.lit("z")) == text.identity_key(b, F.lit("Z"))])
golden("format_signatures", "said string", "signature string", [("AB-12 cd", "A-9 A"), ("é7", "A9"), ("", "")], lambda c: [text.format_signature(c)])

# Audit lines and drug names.
_AUDIT = "Kidneys suffer.\n- Age Risk: False. adult\n7. **Renal Risk:** True. CKD\n- **Liver Risk** - FALSE: none\n- Age Risk: True. again\nFinal verdict: UNSAFE"
golden("audit_lines", "said string", "lines string, prose string", [(_AUDIT, "Liver Risk=false(none);Age Risk=false(adult);Renal Risk=true(CKD)", "kidneys suffer.\nfinal verdict: unsafe"), ("nothing", "", "nothing")], lambda c: [told(F.transform(audit.audit(c, ("Liver Risk", "Age Risk", "Renal Risk", "Gone")), lambda x: F.concat(x["name"], F.lit("="), x["decision"].cast("string"), F.lit("("), x["why"], F.lit(")")))), audit.prose(c)])
_CONCEPTS = {"renal": ["kidney", "renal"], "liver": ["hepat"], "age": ["elderly"]}
golden("decisive_category", "said string, true string", "decisive string, tier string", [
    ("Kidneys fail.\n- Liver: True. hepatic", "liver;renal", "renal", "decisive"), ("Nothing said", "liver;renal", "liver", "minor"), ("Nothing", "renal", "renal", "sole"), ("Hepatic", "age;liver", "liver", "minor"), ("x", "", None, "minor"), ("The elderly", "age", "age", "sole"),
], lambda c, t: [audit.decisive(c, a := F.array_remove(F.split(t, ";"), ""), _CONCEPTS, ("liver", "renal", "age")), audit.severity_tier(c, F.lit("renal"), a, _CONCEPTS)])
golden("drug_names", "said string", "token string, words string", [("Oral Metformin (500 mg) tablet", "metformin", "oral;metformin;tablet"), ("x", "", "x"), ("Vitamin B12", "vitamin", "vitamin;b12"), (None, "", "")], lambda c: [audit.drug_token(c), told(audit.name_words(c))])
golden("drug_lists", "drugs string, drug string", "others string, same boolean", [("Warfarin 5 mg; aspirin (81 mg, daily)", "Aspirin", "warfarin", True), ("None known", "Aspirin", "", False), ("ibuprofen, naproxen 500 mg", "Naproxen", "ibuprofen", True)], lambda c, d: [told(audit.other_drugs(c, d)), audit.same_drug(c, d)])
golden("allergy_keys", "said string", "keys string", [("NKDA", ""), ("Penicillin (rash); sulfonamides", "penicillin;sulfonamides"), ("nuts", "nuts")], lambda c: [told(audit.allergy_words(c))])
golden("product_ingredients", "said string", "parts string", [("Losartan potassium 50mg/hydrochlorothiazide (tab)", "losartan;hydrochlorothiazide"), ("Amoxicillin and clavulanate potassium", "amoxicillin;clavulanate"), ("Metformin-HCl 500 mg", "metformin mg"), ("", "")], lambda c: [told(audit.ingredients(c, ("potassium", "hcl")))])
golden("scrubbed_texts", "said string", "kept string", [("Gout, with CKD stage, pain.", "Gout, with CKD, pain"), ("stage four", "four"), ("stage ii", ""), ("Plain, text", "Plain, text")], lambda c: [audit.scrub(c, ("stage", "ckd"))])
golden("text_sections", "said string", "preamble string, audit string, verdict string", [("Hello\n**Risk Audit:**\n- a\n2. final verdict: SAFE\nRisk audit\nmore", "Hello", "a\nmore", "SAFE"), ("only text", "only text", None, None)], lambda c: [F.element_at(s := audit.sections(c, {"risk audit": "AUDIT", "final verdict": "VERDICT"}), "PREAMBLE"), F.element_at(s, "AUDIT"), F.element_at(s, "VERDICT")])
golden("differing_spans", "a string, b string", "start long, end_a long, end_b long", [("abc", "abc", None, None, None), ("say TRUE now", "say FALSE now", 4, 7, 8), (None, "x", None, None, None), ("aa", "aaa", 2, 2, 3)], lambda a, b: fields(audit.differing_span(a, b), "start", "end_a", "end_b"))

# Answers.
NAMES = ("Drug-Drug Interaction Risk", "Dosage Risk", "Allergy Risk")


def _answer(c):
    a = semi.completion(c, NAMES)
    return [a["safe"], told(a["categories"]), a["source"], a["complete"]]


golden("answer_parser", "said string", "safe boolean, categories string, source string, complete boolean", [
    ('x {"Is_Safe": true, "risk": {"Dosage Risk": false}} y', True, "", "json", False), ('{"Is_Safe": false, "risk": {"Dosage Risk": true, "Aller', False, "Dosage Risk", "partial", False), ("audit ... Final Verdict: UNSAFE", False, "", "prose", False), (None, None, "", "none", False),
    ('```json\n{"risk": {"Dosage": "yes", "Allergy Risk": false, "Drug–Drug Interaction": false}, "verdict": "unsafe"}\n```', False, "Dosage Risk", "json", True), ('{"a": {"b": [{"is_safe": "no"}]}}', False, "", "json", False), ("not safe, then safe", True, "", "prose", False), ("{broken {", None, "", "none", False),
    ('{"Is_Safe": true, "note": "a \\d escape"}', True, "", "json", False), ('{"Is_Safe": True, "x": None}', True, "", "json", False),
], _answer)
golden("strict_answers", "said string", "safe boolean, flags string, ok boolean", [
    ("Sure {'Dosage Risk': True, 'Allergy Risk': False} ok", False, "false;true;false", True), ('{"dosage": "no"}', True, "false;false;false", True), ("it is unsafe", False, "", False), ("nothing", None, "", False),
], lambda c: [(v := generated.strict_vector(c, NAMES))["safe"], F.coalesce(told(F.transform(F.when(v["ok"], v["flags"]), lambda x: x.cast("string"))), F.lit("")), v["ok"]])
golden("key_value_recovery", "said string", "found string", [('{"Dosage Risk": true, "Allergy Risk": "FALSE", "x": 1, ', "Allergy Risk=false;Dosage Risk=true"), ("none", "")], lambda c: [told(F.array_sort(F.transform(F.map_entries(semi.key_values(c, NAMES)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))))])
golden("guard_format", "safe boolean, a boolean, b boolean, c boolean", "said string, back_safe boolean, back string", [(True, False, False, False, "safe", True, ""), (False, True, False, True, "unsafe\nO1,O3", False, "Drug-Drug Interaction Risk;Allergy Risk"), (False, False, False, False, "unsafe\n", False, "")], lambda s, a, b, c: [(said := semi.to_guard(s, F.array(a, b, c))), (g := semi.guard_codes(said, NAMES))["safe"], told(g["names"])])

# Generated texts.
_flags = lambda a: F.transform(F.split(a, ""), lambda x: x == "1")
_places = lambda a: F.filter(F.transform(_flags(a), lambda f, i: F.when(f, (i + 1).cast("string"))), lambda y: y.isNotNull())
golden("label_changes", "a string, b string, target string", "changed string, alone boolean, difference string", [
    ("100", "110", "Dosage Risk", "Dosage Risk", True, "2"), ("100", "001", "Allergy Risk", "Drug-Drug Interaction Risk;Allergy Risk", False, "1;3"), ("100", "100", "Dosage Risk", "", False, ""),
], lambda a, b, t: [told(generated.changed(_flags(a), _flags(b), NAMES)), generated.moved(_flags(a), _flags(b), NAMES, t, F.lit(True)), told(generated.set_difference(_places(a), _places(b)))])
golden("edit_checks", "old string, new string, allowed string, claimed string", "notes string", [
    ("a=1,b=2", "a=1,b=3", "b", "b", ""), ("a=1,b=2", "a=2,b=3", "b", "b", "not allowed:a;not claimed:a"), ("a=1", "a=1", "a", "a", "no change;claimed only:a"), ("a=1", "a=1,c=2", "c", "c", ""),
], lambda o, n, a, c: [told(generated.edit_notes(F.str_to_map(o, F.lit(","), F.lit("=")), F.str_to_map(n, F.lit(","), F.lit("=")), F.split(a, ","), F.split(c, ",")))])
golden("text_similarity", "a string, b string", "ratio double", [("abcd", "bcde", 0.75), ("same", "same", 1.0), ("", "", 1.0), ("ab", "cd", 0.0), (None, "x", None)], lambda a, b: [F.round(generated.similarity(a, b), 6)])
golden("line_checks", "line string, source string", "notes string, invented string", [
    ("The kidneys clear 30 ml each minute", "CrCl 30.0", "", ""), ("Too short", "x", "length", ""), ("It might be a problem here", "x", "hedge", ""), ("A dose of 45 mg is far too high", "40 mg", "invented number", "45.0"),
], lambda a, b: [told(generated.line_notes(a, b)), told(generated.invented_numbers(a, b).cast("array<string>"))])
golden("trace_checks", "trace string, true string", "notes string", [
    ("AUDIT the kidney is weak VERDICT unsafe", "renal", ""), ("AUDIT gold label says so", "renal;liver", "no header VERDICT;leak gold label;not named liver;not named renal"), ("VERDICT", "", "short;no header AUDIT"),
], lambda c, t: [told(generated.trace_notes(c, F.array_remove(F.split(t, ";"), ""), ("AUDIT", "VERDICT"), ("gold label",), {"renal": "kidney", "liver": "hepat"}, 3, 50))])
golden("ceiling_checks", "said string", "conflicts string", [("The maximum is 4 g. A dose of 5 g exceeds it", ""), ("Limit 4000 mg; 3000 mg exceeds the limit", "3000.0"), ("no number", ""), ("max 10, ceiling of 8. 9 clearly exceeds, 8 exceeds", "8.0")], lambda c: [F.array_join(generated.ceiling_conflicts(c).cast("array<string>"), ";")])
golden("forced_prefixes", "said string, value string", "prefix string, word string", [("- Age Risk: TRUE. old", "false", "- Age Risk: ", "FALSE"), ("x\n- Age Risk: False", "true", "x\n- Age Risk: ", "True"), ("nothing true", "true", None, None)], lambda c, v: [(p := generated.forced_prefix(c, "Age Risk")), F.when(p.isNotNull(), generated.styled(v, F.regexp_extract(c, r"(?i)Age Risk[^\n]*?\b(true|false)\b", 1)))])
_JSON = '{\n  "reasoning": "say \\"x\\"",\n  "risk_analysis": {\n    "A": true,\n    "B": false\n  },\n  "is_safe": false\n}'
golden("answer_json", "said string, reason string", "json string, indent long", [(_JSON, 'say "x"', _JSON, 2), ("{}", "r", _JSON.replace('say \\"x\\"', "r"), None)], lambda c, r: [generated.pretty(F.lit(False), (f := F.array(F.lit(True), F.lit(False))), ("A", "B"), r), generated.dump_style(c, F.lit(False), f, ("A", "B"), r)])
golden("first_match_of_columns", "a string, b string", "drug string", [("takes Valacyclovir", "Acyclovir", "Valacyclovir"), ("nothing", "acyclovir 5 mg", "Acyclovir"), (None, None, None), ("Acyclovir then Valacyclovir", "", "Acyclovir")], lambda a, b: [match.first_of((a, b), ("Acyclovir", "Valacyclovir"))])

# Scenario rows.
COLS = {"age": "Age", "sex": "Gender", "weight": "Weight (kg)", "height": "Height (cm)", "bmi": "BMI", "genetic": "Genetic Disorders", "chronic": "Chronic Conditions", "pregnancy": "Pregnancy / Breastfeeding", "allergies": "Drug Allergies", "renal": "Renal Impairment", "hepatic": "Hepatic Impairment", "cardiac": "Cardiac Impairment", "respiratory": "Respiratory Impairment", "alcohol": "Alcohol Use", "tobacco": "Tobacco Use", "substance": "Substance Use", "medications": "Current Medications", "diagnosis": "Diagnosis", "drug": "Recommended Medication", "dosage": "Dosage", "duration": "Duration", "labels": "Risk_Categories", "safe": "Is_Safe", "reasoning": "Reasoning"}
_GOOD = {"age": "50", "sex": "Female", "weight": "70", "height": "175", "bmi": "22.9", "genetic": "None", "chronic": "Asthma", "pregnancy": "Not pregnant", "allergies": "None", "renal": "Moderate (CrCl 45)", "hepatic": "None", "cardiac": "None", "respiratory": "None", "alcohol": "None", "tobacco": "Never", "substance": "None", "medications": "None", "diagnosis": "Gout", "drug": "Allopurinol", "dosage": "100 mg daily", "duration": "2 weeks", "labels": '{"Drug-Drug Interaction Risk": false, "Dosage Risk": false, "Allergy Risk": false}', "safe": "TRUE", "reasoning": "The dose fits the kidneys"}
_ROWS = (
    {}, {"safe": "FALSE"}, {"labels": "{'Drug-Drug Interaction Risk': False, 'Dosage Risk': True, 'Allergy Risk': False}", "safe": "FALSE"}, {"labels": "{'Drug–Drug Interaction Risk': 'x', 'Dosage Risk': true}"}, {"labels": "nothing", "safe": "maybe"},
    {"bmi": "30", "age": "130"}, {"height": "0", "weight": "x"}, {"sex": "Male", "pregnancy": "Pregnant"}, {"pregnancy": "", "dosage": "standard dose"}, {"dosage": "", "drug": None}, {"chronic": "Acute pancreatitis, alcoholic cirrhosis", "tobacco": "never"},
    {"chronic": "COPD", "diagnosis": "heroin"}, {"reasoning": "severe renal disease and glaucoma"}, {"reasoning": "No concerns."}, {"chronic": "None", "renal": "None", "reasoning": "There is nothing that speaks against it"}, {"reasoning": ""}, {"sex": "Male", "pregnancy": "Not applicable"},
)
_FOUND = (
    (1, "is_safe/mismatch", "0"), (2, "categories/needed-repair", "quotes or truth words"), (3, "categories/needed-repair", "quotes or truth words"), (3, "categories/fancy-dash", "Drug–Drug Interaction Risk"), (3, "categories/missing-key", "Drug-Drug Interaction Risk"), (3, "categories/missing-key", "Allergy Risk"),
    (3, "categories/unknown-key", "Drug–Drug Interaction Risk"), (3, "categories/non-boolean", "Drug–Drug Interaction Risk"), (3, "is_safe/mismatch", "1"), (4, "categories/unparseable", "not an object"), (4, "is_safe/unparseable", "maybe"), (5, "bmi/arithmetic", "22.9"), (5, "range/implausible", "Age"),
    (6, "bmi/non-numeric", "x|0|22.9"), (6, "range/non-numeric", "Weight (kg)"), (6, "range/implausible", "Height (cm)"), (7, "pregnancy/male", "pregnant"), (8, "pregnancy/empty", "empty"), (8, "field/empty", "Pregnancy / Breastfeeding"), (8, "dosage/vague", "standard dose"), (8, "dosage/no-number", "standard dose"),
    (9, "dosage/empty", "empty"), (9, "field/empty", "Dosage"), (9, "field/empty", "Recommended Medication"), (10, "field/acute-in-chronic", "acute"), (10, "consistency/substance", "alcoholic cirrhosis | none"), (11, "consistency/substance", "copd | never"), (11, "consistency/substance", "heroin | none"),
    (12, "reasoning/ungrounded", "glaucoma"), (12, "reasoning/severity-mismatch", "severe renal | moderate (crcl 45)"), (13, "reasoning/lazy-safe", "2"), (14, "balance/trivially-safe", "no finding"), (15, "reasoning/empty", "empty"), (15, "field/empty", "Reasoning"),
)


def _scenarios(t):
    ddl = "id long, " + ", ".join(f"`{c}` string" for c in COLS.values())
    return t.spark.createDataFrame([(i, *((_GOOD | r)[k] for k in COLS)) for i, r in enumerate(_ROWS)], ddl)


_REQUIRED = ("Age", "Gender", "Recommended Medication", "Risk_Categories", "Is_Safe", "Reasoning")
_PROFILE = [c for k, c in COLS.items() if k not in ("drug", "dosage", "duration", "labels", "safe", "reasoning", "diagnosis")]


def scenario_issue_log(t):
    return rules.issues(_scenarios(t), "id", validate.scenario(COLS, NAMES, _PROFILE, _REQUIRED)).select("id", "check_name", "detail")


add("scenario_issue_log", "SELECT CAST(id AS BIGINT) AS id, check_name, detail FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in _FOUND) + ") v(id, check_name, detail)", scenario_issue_log)


def scenario_findings(t):
    return _scenarios(t).select("id", validate.findings(COLS).cast("long").alias("n_findings"))


add("scenario_findings", "SELECT CAST(id AS BIGINT) AS id, CAST(n AS BIGINT) AS n_findings FROM (VALUES " + ", ".join(f"({i}, {0 if i == 14 else 2})" for i in range(len(_ROWS))) + ") v(id, n)", scenario_findings)


def schema_columns(t):
    have = [c for c in COLS.values() if c != "BMI"]
    return validate.columns(t.spark, [have[1], have[0], *have[2:], "Notes"], list(COLS.values()))


add("schema_columns", "SELECT * FROM (VALUES ('schema/missing-column', 'BMI'), ('schema/extra-column', 'Notes'), ('schema/column-order', 'not in the expected order')) v(check_name, detail)", schema_columns)


def heading_rules(t):
    rows = [(0, "30", "F", "5 mg", "2 weeks"), (1, "x", "n", "usual", "soon"), (2, "200", "male", "", "")]
    df = t.spark.createDataFrame(rows, "id long, `Age (year)` string, `Sex` string, `Dosing` string, `Duration` string")
    return rules.issues(df, "id", validate.by_heading(df.columns[1:])).select("id", "check_name")


add("heading_rules", "SELECT CAST(id AS BIGINT) AS id, c AS check_name FROM (VALUES (1, 'feature/age'), (1, 'feature/sex'), (1, 'feature/dosage/vague'), (1, 'feature/dosage/no-number'), (1, 'feature/duration'), (2, 'feature/age'), (2, 'feature/dosage/empty'), (2, 'feature/duration')) v(id, c)", heading_rules)
golden("evidence_and_moves", "renal string, allergy string, a boolean, b boolean", "grounds string, add string, drop string", [("CKD", "None", False, True, "renal", "", "allergy"), ("None", "nuts", False, False, "allergy", "renal", ""), ("None", "None", True, False, "", "allergy", "renal")], lambda r, g, a, b: [told(validate.evidence(t := {"renal": ~clinical.is_negative(r), "allergy": ~audit.no_allergy(g)})), told(validate.eligible(f := {"renal": a, "allergy": b}, t, "add")), told(validate.eligible(f, t, "drop"))])
