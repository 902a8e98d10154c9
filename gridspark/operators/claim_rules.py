"""Claim rules as data: patterns, weights, explanations and safe wording per category and language.

Fixed values throughout: the categories, weights, patterns and phrases define which texts are flagged.
``needs`` lists literals of which every pattern of the rule contains at least one: a text without any of
them cannot match, so its regular expressions are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ClaimRule:
    category: str
    severity: str
    weight: int
    en: tuple[str, ...]
    ru: tuple[str, ...]
    safe_en: str
    safe_ru: str
    rewrite_en: str
    rewrite_ru: str
    needs: tuple[str, ...] = ()


SEVERITIES = ("none", "low", "medium", "high", "critical")

# Rules in evaluation order.
CLAIM_RULES: tuple[ClaimRule, ...] = (
    ClaimRule(
        "TRUE_CENSUS_RECONSTRUCTION",
        "critical",
        40,
        (
            r"\btrue\s+(?:cell[- ]level\s+)?census(?:\s+reconstruction|\s+counts?)?\b",
            r"\bactual\s+census\s+reconstruction\b",
            r"\bexact\s+cell[- ]level\s+census\b",
            r"\breal\s+population\s+at\s+(?:the\s+)?cell\s+level\b",
            r"\breconstruct(?:ed|s)?\s+(?:the\s+)?true\s+population\b",
            r"\bofficial\s+cell[- ]level\s+(?:population|census)\b",
        ),
        (
            r"\bперепис\w*\s+как\s+истин\w*\b",
            r"\bточн\w*\s+перепис\w*\b",
            r"\bточн\w*\s+населен\w*\s+ячейк\w*\b",
            r"\bреальн\w*\s+населен\w*\b",
            r"\bофициальн\w*\s+перепис\w*\s+на\s+уровне\s+ячейк\w*\b",
        ),
        "calibrated proxy population surface",
        "calibrated proxy population surface",
        "Cell values are proxy estimates, not observed census counts.",
        "Значения ячеек являются proxy estimates, а не наблюдаемыми census counts.",
        needs=("census", "population", "перепис", "населен"),
    ),
    ClaimRule(
        "TRUE_UNCERTAINTY",
        "critical",
        40,
        (
            r"\btrue\s+(?:census\s+)?uncertainty(?:\s+bounds?|\s+intervals?)?\b",
            r"\bactual\s+uncertainty\s+interval\b",
            r"\bcensus\s+confidence\s+interval\b",
            r"\bp10\s*/?\s*p50\s*/?\s*p90\s+(?:represent|are|show)\s+real\s+census\s+uncertainty\b",
        ),
        (
            r"\bистинн\w*\s+неопредел[её]нност\w*\b",
            r"\bреальн\w*\s+интервал\w*\s+неопредел[её]нност\w*\b",
            r"\bдоверительн\w*\s+интервал\w*\s+перепис\w*\b",
        ),
        "proxy interval",
        "proxy-интервал",
        "P10/P50/P90 describe ensemble spread inside the proxy framework, not true census uncertainty.",
        "P10/P50/P90 описывают ensemble spread внутри proxy framework, а не true census uncertainty.",
        needs=("uncertainty", "census", "неопредел", "перепис"),
    ),
    ClaimRule(
        "CONFIDENCE_AS_PROBABILITY",
        "high",
        30,
        (
            r"\bconfidence_score\s+(?:is|means|equals|=)\s+(?:a\s+)?probability\b",
            r"\bprobability\s+of\s+correctness\b",
            r"\b\d{1,3}%\s+chance\s+(?:that\s+)?(?:the\s+)?cell\s+is\s+correct\b",
            r"\bhigh\s+confidence\s+means\s+true\b",
            r"\bconfidence\s+band\s+proves?\s+correctness\b",
        ),
        (
            r"\bвероятност\w*\s+правильност\w*\b",
            r"\bconfidence_score\s*[-—=]?\s*(?:это\s+)?вероятност\w*\b",
            r"\bвысок\w*\s+confidence\s+означает\s+истин\w*\b",
        ),
        "interpretation-confidence score",
        "interpretation-confidence score",
        "confidence_score is an interpretation-confidence score, not a probability of correctness.",
        "confidence_score — interpretation-confidence score, а не probability of correctness.",
        needs=("probability", "chance", "confidence", "вероятност"),
    ),
    ClaimRule(
        "EXTERNAL_PRODUCTS_AS_GROUND_TRUTH",
        "high",
        30,
        (
            r"\b(?:worldpop|ghs[- ]?pop)\s+(?:is|as|provides?)\s+(?:the\s+)?ground\s*truth\b",
            r"\bexternal\s+benchmark\s+proves?\s+(?:the\s+)?truth\b",
            r"\bvalidated\s+against\s+true\s+population\s+using\s+(?:worldpop|ghs[- ]?pop)\b",
            r"\bground\s*truth\b",
        ),
        (r"\b(?:worldpop|ghs[- ]?pop)\s*[-—]?\s*(?:это\s+)?ground\s*truth\b", r"\bground\s*truth\b"),
        "structural comparator",
        "structural comparator",
        "WorldPop and GHS-POP are structural comparators, not ground truth.",
        "WorldPop и GHS-POP используются как structural comparators, а не ground truth.",
        needs=("ground", "benchmark", "validated"),
    ),
    ClaimRule(
        "VERIFIED_HOTSPOT_TRUTH",
        "high",
        30,
        (
            r"\bverified\s+(?:population\s+)?hotspot\b",
            r"\btrue\s+(?:population\s+)?hotspot\b",
            r"\bconfirmed\s+population\s+hotspot\b",
            r"\bhotspot\s+class\s+proves?\s+real\s+concentration\b",
            r"\bhigh[- ]priority\s+cell\s+is\s+definitely\s+(?:the\s+)?most\s+populated\b",
        ),
        (
            r"\bподтвержд[её]нн\w*\s+hotspot\b",
            r"\bдоказанн\w*\s+hotspot\b",
            r"\bhotspot\s+доказан\w*\b",
            r"\bистинн\w*\s+hotspot\b",
        ),
        "screening candidate",
        "screening candidate",
        "hotspot_priority_class is a screening/triage class, not verified hotspot truth.",
        "hotspot_priority_class обозначает screening/triage class, а не verified hotspot truth.",
        needs=("hotspot", "priority"),
    ),
    ClaimRule(
        "LLM_IMPROVES_PREDICTION_ACCURACY",
        "critical",
        40,
        (
            r"\b(?:llm|gemini)\s+(?:improves?|improved|increases?)\s+(?:population\s+)?prediction\s+accuracy\b",
            r"\bgemini\s+makes?\s+(?:the\s+)?surface\s+more\s+accurate\b",
            r"\bchatbot\s+corrects?\s+(?:the\s+)?population\s+estimates?\b",
            r"\bllm\s+predicts?\s+missing\s+population\b",
        ),
        (
            r"\bllm\s+улучш\w*\s+точност\w*\s+населен\w*\b",
            r"\bgemini\s+делает\s+поверхност\w*\s+точнее\b",
            r"\bчатбот\s+исправляет\s+оценк\w*\s+населен\w*\b",
        ),
        "evidence-linked explanation",
        "evidence-linked explanation",
        "The text layer explains frozen outputs and does not change population estimates or prediction accuracy.",
        "Текстовый слой объясняет frozen outputs и не изменяет population estimates или accuracy.",
        needs=("accura", "chatbot", "llm", "gemini", "чатбот"),
    ),
    ClaimRule(
        "AUTOMATED_POLICY_DECISION",
        "high",
        30,
        (
            r"\bcan\s+be\s+used\s+directly\s+for\s+official\s+policy\b",
            r"\bfully\s+automated\s+(?:administrative|policy)\s+decision\b",
            r"\bno\s+manual\s+review\s+(?:is\s+)?needed\b",
            r"\bdefinitive\s+planning\s+decision\b",
        ),
        (
            r"\bможно\s+использовать\s+без\s+ручн\w*\s+проверк\w*\b",
            r"\bполност\w*\s+автоматиз\w*\s+(?:административн\w*|политическ\w*)\s+решен\w*\b",
            r"\bокончательн\w*\s+планировочн\w*\s+решен\w*\b",
        ),
        "manual review recommended",
        "требует ручной проверки",
        "The result supports preliminary screening and requires manual review.",
        "Результат поддерживает предварительный screening и требует ручной проверки.",
        needs=("policy", "administrative", "manual", "planning", "проверк", "решен"),
    ),
    ClaimRule(
        "FAKE_PRECISION_OR_OVERCONFIDENCE",
        "medium",
        18,
        (
            r"\bexact\s+number\s+of\s+people\s+live\s+here\b",
            r"\bdefinitely\b",
            r"\bproves?\b",
            r"\bguarantees?\b",
            r"\baccurate\s+at\s+(?:the\s+)?cell\s+level\b",
            r"\bno\s+uncertainty\b",
        ),
        (
            r"\bточн\w*\s+числ\w*\s+людей\s+жив[её]т\s+здесь\b",
            r"\bоднозначно\b",
            r"\bдоказывает\b",
            r"\bгарантирует\b",
            r"\bбез\s+неопредел[её]нност\w*\b",
        ),
        "bounded proxy interpretation",
        "bounded proxy interpretation",
        "Numerical outputs are bounded proxy evidence without a guarantee of cell-level accuracy.",
        "Числа следует интерпретировать как bounded proxy evidence без гарантии cell-level accuracy.",
        needs=("exact", "definitely", "prove", "guarantee", "accurate", "uncertainty", "точн", "однозначно", "доказывает", "гарантирует", "неопредел"),
    ),
)

# Words that negate a claim in the same clause, and how far back to look.
NEGATION_WORDS = ("not", "never", "without", "cannot", "can't", "isn't", "aren't", "doesn't", "не", "нельзя")
LOOK_BACK = 100

# Labels and patterns of the light check.
LIGHT_RULES: dict[str, tuple[str, ...]] = {
    "true_census": (
        r"\btrue\s+(?:cell[- ]level\s+)?census\b",
        r"\breconstructs?\s+(?:the\s+)?true\s+population\b",
        r"истинн\w*\s+(?:данн\w*\s+)?перепис",
    ),
    "exact_population": (
        r"\bexact\s+(?:cell[- ]level\s+)?population\b",
        r"\baccurately\s+reconstructs?\b",
        r"точн\w*\s+численност",
    ),
    "ground_truth": (r"\bground\s*truth\b", r"наземн\w*\s+истин", r"эталонн\w*\s+истин"),
    "correctness_probability": (
        r"\bprobability\s+of\s+correctness\b",
        r"confidence_score\s+(?:is|means)\s+(?:a\s+)?probability",
        r"вероятност\w*\s+правильност",
    ),
    "verified_hotspot": (r"\bverified\s+(?:population\s+)?hotspot\b", r"подтвержденн\w*\s+hotspot"),
    "official_cell_census": (r"\bofficial\s+cell[- ]level\s+census\b", r"официальн\w*\s+перепис\w*\s+по\s+ячей"),
    "automated_policy": (r"\bfully\s+automated\s+policy\b", r"полност\w*\s+автоматиз\w*\s+решен"),
    "llm_accuracy": (
        r"\bllm\s+improv(?:es|ed)\s+(?:population\s+)?prediction\s+accuracy\b",
        r"llm\s+улучш\w*\s+точност\w*\s+прогноз",
    ),
}
