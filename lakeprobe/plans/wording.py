"""Texts of findings: what each means, its limits and what to do; the numbers come from the analyzers."""

from __future__ import annotations

from collections.abc import Iterable

from ..core.results import Finding, Severity

#: key: (category, title, interpretation, limitations, recommendation)
TEXTS: dict[str, tuple[str, str, str, str, str | None]] = {
    "missing_column": ("missingness", "A column has missing values", "Rows without this value are dropped or filled by most models.", "Counts say how much is missing, not why.", "Find out why the values are missing before filling or dropping them."),
    "missing_target": ("missingness", "The target has missing values", "Rows without a target can't be learned from or scored.", "Counts say how much is missing, not why.", "Drop these rows, or find their outcome."),
    "missing_rows": ("missingness", "Many rows are incomplete", "Dropping incomplete rows would lose this share of the data.", "A row counts whichever columns it lacks.", "Prefer filling or models that accept missing values to dropping rows."),
    "missing_pairs": ("missingness", "Columns are missing together", "Values absent in the same rows often have one cause, such as an unfilled form or a failed join.", "Correlation of absence doesn't show the cause.", "Look for the common source of these columns."),
    "missing_depends": ("missingness", "Missing values depend on other columns", "The absence isn't random, so dropping these rows would bias what is left.", "Only the observed columns were tried, one at a time.", "Model the absence, for example with an indicator, instead of dropping rows."),
    "missing_untested": ("missingness", "Whether missing values depend on others is unknown", "No comparison was possible for these columns.", "The reasons are given as evidence.", None),
    "missing_token": ("missingness", "The text NA was read as missing in a column of codes", "It may be a genuine code, such as a country's.", "Judged from the other values' shape.", "Read the column as text if NA is a code."),
    "duplicate_rows": ("duplicates", "Rows are repeated", "Copies weigh more than other rows and can land on both sides of a split.", "Rows are equal only if all compared values are.", "Remove copies before splitting unless they are real events."),
    "duplicate_hidden": ("duplicates", "Rows are repeated apart from their identifiers", "A new identifier may have been given to the same record.", "Distinct records can agree by chance when columns are few.", "Check whether these are one record entered more than once."),
    "duplicate_ids": ("duplicates", "An identifier occurs more than once", "Records that share an identifier are copies, versions or several events of one entity.", "Only columns named like identifiers are checked.", "Decide whether one row for each identifier is meant."),
    "duplicate_left_out": ("duplicates", "Columns could not be compared", "Nested values have no agreed equality, so copies were judged without them.", "More rows may differ than was seen.", None),
    "constant_target": ("constants", "The target has a single value", "There is nothing to predict.", "Holds for the rows at hand.", "Check the extraction or choose another target."),
    "constants": ("constants", "Columns have a single value", "They carry no information in this table.", "They may vary in other extracts.", "Leave them out of the features."),
    "near_constants": ("constants", "Columns have nearly always the same value", "The rare values may matter, or be too few to learn from.", "At least 99 of 100 values are equal.", "Check what the rare values mean."),
    "constants_unchecked": ("constants", "Columns were not checked for constancy", "Nested values can't be counted as distinct.", "They may be constant.", None),
    "outliers_extreme": ("outliers", "Columns have extreme values", "They lie far from the rest by two rules and can dominate means and models.", "A rule can't tell an error from a rare event.", "Check their source before changing anything."),
    "outliers_some": ("outliers", "Columns have unusual values", "Long tails give such values without any error.", "Either rule alone is easily met.", None),
    "outliers_skipped": ("outliers", "Columns were too short or too flat for outlier rules", "The rules need thirty values, ten of them distinct, and some spread.", "They may still hold odd values.", None),
    "outliers_infinite": ("outliers", "Columns hold infinite values", "They usually come from a division by zero and break means.", "They were left out of all statistics.", "Trace the calculation that gave them."),
    "text_numbers": ("dtypes", "Numbers are stored as text", "They sort and compare as text until converted.", "Only plain numbers and thousands commas are recognised.", "Convert them; decide what the other tokens mean."),
    "text_codes": ("dtypes", "Text columns hold codes with leading zeros", "Conversion to numbers would lose the zeros.", "Judged from leading zeros alone.", "Keep them as text."),
    "lost_zeros": ("dtypes", "Leading zeros were lost when the file was read", "The file's text had zeros that the numbers no longer have.", "Judged on the first rows of the file.", "Read these columns as text."),
    "mixed_types": ("dtypes", "Columns mix types of values", "Operations meant for one type fail or mislead on the others.", "Types are those of the stored values.", "Settle on one type at the source."),
    "age_negative": ("impossible_values", "Ages are negative", "No age is below zero.", "Taken for an age because of its name.", "Correct or blank these values."),
    "age_high": ("impossible_values", "Ages are above 120", "They are far beyond known human ages.", "The unit may not be years.", "Check the unit and the source."),
    "quantity_negative": ("impossible_values", "Quantities are negative", "Such a quantity can't be below zero.", "Taken for a quantity because of its name.", "Check the sign convention."),
    "dates_invalid": ("impossible_values", "Dates do not exist", "The text has a date's shape but no such day exists.", "Only the calendar was checked.", "Correct them at the source."),
    "dates_future": ("impossible_values", "Dates lie in the future", "A recorded date after the reference day is often an error or a placeholder.", "Planned dates may be right.", "Check how these dates arise."),
    "pii": ("privacy", "Columns may hold personal data", "Personal data needs a purpose, protection and often consent.", "Shapes and names are signs, not proof; no value is shown.", "Remove, mask or justify these columns before sharing."),
    "eda_not_plotted": ("eda", "Columns were not drawn", "Their kind has no simple picture.", "Their counts are in the metrics.", None),
    "eda_pages": ("eda", "Not all columns fit the figures", "Figures are limited to four pages of each kind.", "All statistics are in the metrics.", None),
    "eda_hidden": ("eda", "Labels were left out for privacy", "The columns may hold personal data.", "Counts are kept, values are not.", None),
    "eda_correlated": ("eda", "Numeric columns are strongly correlated", "They carry much the same information.", "Only straight-line relations count.", "Consider keeping one of each pair."),
    "eda_predictors": ("eda", "Columns are associated with the target", "They are likely to help a model.", "Association isn't cause, and columns were tried one at a time.", None),
    "eda_imbalance": ("eda", "The target's classes are unbalanced", "Accuracy rewards ignoring the rare class.", "Shares are of the rows at hand.", "Stratify splits and choose a measure that counts the rare class."),
    "eda_not_used": ("eda", "Columns were not compared", "Their kind has no association measure here.", "They may still matter.", None),
    "eda_not_tested": ("eda", "Columns could not be compared with the target", "Too many categories or too few rows for a sound measure.", "They may still matter.", None),
    "eda_target": ("eda", "The target can't be used for associations", "Only numeric, categorical and yes-or-no targets can.", "Judged from the inferred type.", "Choose or derive another target."),
    "split_time": ("split_strategy", "The target changes with time", "A random split would let a model see the future.", "One measure for each date column.", "Split by time."),
    "split_group": ("split_strategy", "The target depends on a group", "Rows of one group on both sides of a split leak its level.", "Groups are recognised by name.", "Keep each group on one side."),
    "split_small": ("split_strategy", "A test set would be small", "Scores on few rows are uncertain.", "A fifth of the rows is assumed for the test.", "Use cross-validation."),
    "split_strata": ("split_strategy", "A random split may starve a class", "The rare class may be nearly absent on one side.", "Shares are of the rows at hand.", "Stratify the split."),
    "leak_near": ("leakage", "Columns predict the target almost perfectly", "Such strength is more often leakage than luck.", "A real cause can be this strong.", "Check whether the value is known when predicting."),
    "leak_copy": ("leakage", "Columns look like copies of the target", "They encode the answer.", "Judged from the strength alone.", "Remove them from the features."),
    "leak_names": ("leakage", "Columns are named like later events", "They may be recorded after the outcome.", "Judged from English names alone.", "Check when they are recorded."),
    "ready_unassessed": ("readiness", "Readiness was not assessed", "No target was named.", "Nothing that needs a target was checked.", "Name a target."),
    "ready_target": ("readiness", "The target's type can't be modelled", "Only numeric, categorical and yes-or-no targets can.", "Judged from the inferred type.", "Choose or derive another target."),
    "ready_blocked": ("readiness", "Not ready for modelling", "At least one finding would invalidate a model or its evaluation.", "Only known checks are covered.", "Resolve the blocking findings first."),
    "ready_attention": ("readiness", "Ready with reservations", "No finding blocks modelling, some need a decision.", "Only known checks are covered.", "Go through the findings listed."),
    "ready": ("readiness", "No obstacle to modelling was found", "None of the checks found a reason to wait.", "Only known checks are covered.", None),
}


def finding(key: str, severity: Severity, confidence: float, evidence: str, columns: Iterable[str] = (), title: str | None = None) -> Finding:
    category, usual, interpretation, limitations, advice = TEXTS[key]
    return Finding(category=category, severity=severity, confidence=confidence, title=title or usual, evidence=evidence, interpretation=interpretation, limitations=limitations, affected_columns=tuple(columns), recommendation=advice)


def title_of(key: str) -> str:
    return TEXTS[key][1]
