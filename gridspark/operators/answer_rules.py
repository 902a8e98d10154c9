"""Rule rows of template answers: which sentence stands in which section, and when.

A row is (kind, section, condition, English, Russian). Rows of a section keep their order. ``{path}`` is a number of the
pack, ``{path%}`` a percentage, ``{path$}`` plain text, ``{area}`` the area's name; a text that is one path in brackets
stands for all items of that array. Conditions are those of ``answers.conditions``; of summaries the first that holds is taken.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    kind: str
    section: str
    when: str
    en: str
    ru: str

    def text(self, language: str) -> str:
        return self.ru if language == "ru" else self.en


#: Sections in the order of the composed answer, with their headings.
SECTIONS = {
    "summary": {"en": "Summary", "ru": "Краткий вывод"},
    "evidence": {"en": "Evidence", "ru": "Основания"},
    "hotspots": {"en": "Reading the classes", "ru": "Как читать классы"},
    "reliability": {"en": "Reading the intervals", "ru": "Как читать интервалы"},
    "allowed": {"en": "Fit to say", "ru": "Можно утверждать"},
    "not_allowed": {"en": "Not fit to say", "ru": "Нельзя утверждать"},
    "stable": {"en": "Stable examples", "ru": "Устойчивые примеры"},
    "caution": {"en": "Examples to treat with care", "ru": "Примеры, требующие осторожности"},
    "ranking": {"en": "About the order", "ru": "О порядке"},
    "cautions": {"en": "Limits", "ru": "Ограничения"},
    "next": {"en": "What to check next", "ru": "Что проверить дальше"},
}
NO_VALUE = {"en": "no value", "ru": "нет данных"}
NO_NAME = {"en": "This area", "ru": "Эта территория"}

_PROXY = (
    "Values of cells are proxy estimates that share out one total; nobody was counted cell by cell.",
    "Значения ячеек — это proxy-оценки, делящие один итог; по ячейкам никого не считали.",
)
_SCORE = (
    "A confidence score sorts cells by the evidence behind them and gives no chance of being right.",
    "Confidence score сортирует ячейки по основаниям и не даёт шанса на правоту.",
)
_CLASS = (
    "Priority classes are for screening: they say where to look and confirm nothing.",
    "Классы приоритета служат для screening: они говорят, куда смотреть, и ничего не подтверждают.",
)
_LIMITED = (
    "Leave intervals and classes out of any reading: evidence for this area is limited.",
    "Не опирайтесь на интервалы и классы: данных по этой территории недостаточно, часть их отсутствует.",
)
_MISSING = (
    "Some evidence is missing: [missing_artifacts].",
    "Часть данных отсутствует: [missing_artifacts].",
)
_LANGUAGE = ("The language asked for is not offered, so this answer is in English.",) * 2

RULES: tuple[Rule, ...] = tuple(
    Rule(*row)
    for row in (
        ("city_brief", "summary", "full", "{area}: estimates by cell come with intervals, confidence bands and screening classes.", "{area}: у оценок по ячейкам есть интервалы, уровни уверенности и классы для screening."),
        ("city_brief", "summary", "basic", "{area}: a total and a registry entry are known; how reliable its cells are was never assessed.", "{area}: известны итог и запись реестра; надёжность ячеек не оценивалась."),
        ("city_brief", "summary", "partial", "{area}: what is registered is partial, and so is this answer.", "{area}: в реестре лишь часть данных, поэтому и ответ неполный."),
        ("city_brief", "summary", "any", "{area}: nothing is registered under this name, so evidence is missing.", "{area}: под этим именем в реестре ничего нет, данные отсутствуют."),
        ("city_brief", "evidence", "any", "Support: {city_summary.support_level$}.", "Поддержка: {city_summary.support_level$}."),
        ("city_brief", "evidence", "any", "Total that the cells add up to: {city_summary.official_total}.", "Итог, который складывают ячейки: {city_summary.official_total}."),
        ("city_brief", "evidence", "any", "Cells: {city_summary.cell_count}.", "Ячеек: {city_summary.cell_count}."),
        ("city_brief", "evidence", "full", "Interval width over estimate, median of cells: {city_summary.median_relative_uncertainty}.", "Ширина интервала к оценке, медиана по ячейкам: {city_summary.median_relative_uncertainty}."),
        ("city_brief", "evidence", "full", "Bands: {confidence_summary.high_share%} of cells high, {confidence_summary.medium_share%} medium, {confidence_summary.low_share%} low.", "Уровни: {confidence_summary.high_share%} ячеек high, {confidence_summary.medium_share%} medium, {confidence_summary.low_share%} low."),
        ("city_brief", "evidence", "full", "Cells to look at first: {hotspot_summary.n_priority_cells}; high in value and confidence: {hotspot_summary.n_high_value_high_confidence}.", "Ячеек для первого просмотра: {hotspot_summary.n_priority_cells}; high_value_high_confidence: {hotspot_summary.n_high_value_high_confidence}."),
        ("city_brief", "hotspots", "full", "{hotspot_summary.interpretation$}", "{hotspot_summary.interpretation$}"),
        ("city_brief", "reliability", "full", "A wide interval and a low band both tell of thin evidence; read them together before a cell is used.", "Широкий интервал и уровень low говорят о слабых основаниях; читайте их вместе, прежде чем брать ячейку."),
        ("city_brief", "allowed", "any", "[city_summary.allowed]", "[city_summary.allowed]"),
        ("city_brief", "not_allowed", "any", "[city_summary.caution]", "[city_summary.caution]"),
        ("city_brief", "cautions", "any", *_PROXY),
        ("city_brief", "cautions", "any", *_SCORE),
        ("city_brief", "cautions", "any", *_CLASS),
        ("city_brief", "next", "any", "See how fully buildings are mapped there before leaning on single cells.", "Посмотрите, насколько полно нанесены здания, прежде чем опираться на отдельные ячейки."),
        ("city_brief", "next", "limited", *_LIMITED),
        ("hotspot_review", "summary", "full", "{area}: {hotspot_summary.n_priority_cells} cells stand out for a first look.", "{area}: для первого просмотра выделяются ячейки, всего {hotspot_summary.n_priority_cells}."),
        ("hotspot_review", "summary", "any", "{area}: classes are unavailable, so no cell can be singled out.", "{area}: классы недоступны, поэтому выделить ячейки нельзя."),
        *[
            ("hotspot_review", "evidence", "full", f"{name}: {{hotspot_summary.n_{name}}} cells.", f"{name}: ячеек {{hotspot_summary.n_{name}}}.")
            for name in ("high_value_high_confidence", "high_value_low_confidence", "medium_value_high_confidence", "low_value_high_uncertainty")
        ],
        ("hotspot_review", "evidence", "full", "In stable classes: {hotspot_summary.stable_hotspot_cells}; in classes of caution: {hotspot_summary.caution_hotspot_cells}.", "В устойчивых классах: {hotspot_summary.stable_hotspot_cells}; в классах с оговоркой: {hotspot_summary.caution_hotspot_cells}."),
        ("hotspot_review", "hotspots", "any", "{hotspot_summary.interpretation$}", "{hotspot_summary.interpretation$}"),
        ("hotspot_review", "stable", "full", "[hotspot_summary.stable_examples.cell_id]", "[hotspot_summary.stable_examples.cell_id]"),
        ("hotspot_review", "caution", "full", "[hotspot_summary.caution_examples.cell_id]", "[hotspot_summary.caution_examples.cell_id]"),
        ("hotspot_review", "cautions", "any", *_CLASS),
        ("hotspot_review", "cautions", "any", *_PROXY),
        ("hotspot_review", "next", "full", "Hold cells in classes of caution against local data first, and rank nothing before that.", "Сначала сверьте ячейки с оговоркой с местными данными и до этого ничего не ранжируйте."),
        ("hotspot_review", "next", "limited", *_LIMITED),
        ("uncertainty_summary", "summary", "any", "{area}: P50 is the middle of the ensemble's estimates; a tenth of them lies under P10 and a tenth over P90.", "{area}: P50 — середина оценок ансамбля; десятая часть ниже P10, десятая часть выше P90."),
        ("uncertainty_summary", "evidence", "any", "Interval width over estimate, median of cells: {uncertainty_summary.median_relative_uncertainty}.", "Ширина интервала к оценке, медиана по ячейкам: {uncertainty_summary.median_relative_uncertainty}."),
        ("uncertainty_summary", "evidence", "full", "Interval width, median of cells: {uncertainty_summary.median_interval_width}.", "Ширина интервала, медиана по ячейкам: {uncertainty_summary.median_interval_width}."),
        ("uncertainty_summary", "evidence", "full", "Weak targets between P10 and P90: {uncertainty_summary.weak_target_interval_coverage%}.", "Слабых целей между P10 и P90: {uncertainty_summary.weak_target_interval_coverage%}."),
        ("uncertainty_summary", "evidence", "aligned", "Error against width: Pearson {uncertainty_summary.error_width_alignment.pearson}, Spearman {uncertainty_summary.error_width_alignment.spearman}.", "Ошибка и ширина: Pearson {uncertainty_summary.error_width_alignment.pearson}, Spearman {uncertainty_summary.error_width_alignment.spearman}."),
        ("uncertainty_summary", "cautions", "any", "Intervals show how far the ensemble's members part; an error that all of them share stays unseen.", "Интервалы показывают расхождение членов ансамбля; общая для всех ошибка остаётся невидимой."),
        ("uncertainty_summary", "cautions", "full", "Coverage and alignment were measured on weak targets and are limited evidence.", "Coverage и alignment измерены на слабых целях и остаются limited evidence."),
        ("uncertainty_summary", "next", "full", "Go through the widest intervals by hand, with a map beside them.", "Просмотрите вручную самые широкие интервалы рядом с картой."),
        ("uncertainty_summary", "next", "limited", *_LIMITED),
        ("confidence_summary", "summary", "any", "{area}: bands sort cells by how well evidence carries their estimates.", "{area}: уровни сортируют ячейки по тому, насколько основания держат оценку."),
        *[("confidence_summary", "evidence", "any", f"Band {b}: {{confidence_summary.{b}_share%}} of cells.", f"Уровень {b}: {{confidence_summary.{b}_share%}} ячеек.") for b in ("high", "medium", "low")],
        ("confidence_summary", "cautions", "any", *_SCORE),
        ("confidence_summary", "cautions", "any", *_PROXY),
        ("confidence_summary", "next", "full", "Pass cells of the low band on to a person instead of dropping them.", "Передайте ячейки уровня low человеку, а не отбрасывайте их."),
        ("confidence_summary", "next", "limited", *_LIMITED),
        ("compare_cities", "summary", "any", "What differs between areas here is the evidence behind their estimates.", "Здесь территории различаются основаниями, на которых стоят их оценки."),
        ("compare_cities", "evidence", "compared", "Most cells of high confidence: {city_comparison.highest_confidence$}.", "Больше всего ячеек уровня high: {city_comparison.highest_confidence$}."),
        ("compare_cities", "evidence", "compared", "Widest intervals by median: {city_comparison.highest_uncertainty$}.", "Самые широкие интервалы по медиане: {city_comparison.highest_uncertainty$}."),
        ("compare_cities", "evidence", "not_compared", "No area with full evidence was given, so a comparison is unavailable.", "Территорий с полными данными не дано, сравнение недоступно."),
        ("compare_cities", "ranking", "compared", "The first place goes to evidence, and says nothing about the people who live there.", "Первое место достаётся основаниям и ничего не говорит о жителях."),
        ("compare_cities", "cautions", "any", "Better evidence does not bring an estimate closer to the people who live there.", "Лучшие основания не делают оценку ближе к числу жителей."),
        ("compare_cities", "cautions", "any", *_PROXY),
        ("compare_cities", "next", "any", "Hold only areas of one support level against each other.", "Сопоставляйте только территории одного уровня поддержки."),
        ("explain_cell", "summary", "found", "{area}, cell {cell_evidence.requested_cell$}: {cell_evidence.p50} by estimate, band {cell_evidence.confidence_band$}, class {cell_evidence.hotspot_priority_class$}.", "{area}, ячейка {cell_evidence.requested_cell$}: {cell_evidence.p50} по оценке, уровень {cell_evidence.confidence_band$}, класс {cell_evidence.hotspot_priority_class$}."),
        ("explain_cell", "summary", "any", "{area}: the cell was not found. {cell_evidence.reason$}", "{area}: ячейка не найдена, данные отсутствуют. {cell_evidence.reason$}"),
        ("explain_cell", "evidence", "found", "P10 {cell_evidence.p10}, P50 {cell_evidence.p50}, P90 {cell_evidence.p90}.", "P10 {cell_evidence.p10}, P50 {cell_evidence.p50}, P90 {cell_evidence.p90}."),
        ("explain_cell", "evidence", "found", "Interval width over estimate: {cell_evidence.relative_uncertainty}.", "Ширина интервала к оценке: {cell_evidence.relative_uncertainty}."),
        ("explain_cell", "evidence", "found", "Confidence score: {cell_evidence.confidence_score}.", "Confidence score: {cell_evidence.confidence_score}."),
        ("explain_cell", "cautions", "any", *_PROXY),
        ("explain_cell", "cautions", "found", *_SCORE),
        ("explain_cell", "next", "found", "Hold the cell against a map and a source from the place itself.", "Сверьте ячейку с картой и местным источником."),
        ("explain_cell", "next", "not_found", "Look the identifier up in the published grid and ask again.", "Найдите идентификатор в опубликованной сетке и спросите снова."),
        ("reviewer_safe", "summary", "policy", "No. For this, take figures of the statistical office; estimates by cell are no substitute for them.", "Нет. Возьмите для этого данные статистического ведомства; оценки по ячейкам их не заменяют."),
        ("reviewer_safe", "summary", "any", "The estimates may be quoted as modelled and limited evidence, within the limits below.", "Оценки можно приводить как модельные и ограниченные данные, в пределах ниже."),
        ("reviewer_safe", "evidence", "any", "At hand: proxy estimates by cell and the published checks on them.", "В наличии: proxy-оценки по ячейкам и опубликованные проверки."),
        ("reviewer_safe", "evidence", "any", "Support of {area}: {city_summary.support_level$}.", "Поддержка, {area}: {city_summary.support_level$}."),
        ("reviewer_safe", "evidence", "full", "Cells with priority: {hotspot_summary.n_priority_cells}.", "Ячеек с приоритетом: {hotspot_summary.n_priority_cells}."),
        ("reviewer_safe", "cautions", "any", *_PROXY),
        ("reviewer_safe", "cautions", "any", *_SCORE),
        ("reviewer_safe", "cautions", "any", *_CLASS),
        ("reviewer_safe", "cautions", "any", "Other gridded products are comparisons of shape; agreement with them settles nothing.", "Другие сеточные продукты служат для сравнения формы; совпадение с ними ничего не решает."),
        ("reviewer_safe", "cautions", "any", "For reviewers: evidence that is mixed or missing counts against a claim.", "Для рецензентов: смешанные или отсутствующие данные говорят против утверждения."),
        ("reviewer_safe", "next", "any", "Before a decision, have someone outside review it and bring in local figures.", "Перед решением получите внешнюю проверку и местные данные."),
        ("reviewer_safe", "next", "limited", *_LIMITED),
    )
)
KINDS = tuple(dict.fromkeys(rule.kind for rule in RULES))

#: Rows that stand at the end of a section of every kind.
COMMON: tuple[tuple[str, str, str, str], ...] = (("cautions", "missing", *_MISSING), ("cautions", "other_language", *_LANGUAGE))


def rules_of(kind: str, section: str) -> list[Rule]:
    return [x for x in RULES if (x.kind, x.section) == (kind, section)] + [Rule(kind, *x) for x in COMMON if x[0] == section]


# Words that make a question one of policy.
POLICY_WORDS = ("official census", "census evidence", "policy", "перепис", "официаль")
CHECK = {
    True: "The statement says more than proxy estimates can carry. Call values modelled, give their limits, and name no cell as proven.",
    False: "No phrase of the list was found. The statement still needs evidence that it can be traced to.",
}
CHECK_NOTE = "Only phrases were looked for here; the claim scan reads whole texts under all rules, this check is limited."
CHECK_NEXT = "Run the claim scan before the statement is published."
