"""Why a step is refused."""

from __future__ import annotations

#: The wording that readers and callers rely on.
REASONS = {
    "unknown": 'There is no column named "{name}" at this point in the recipe.',
    "removed": " An earlier step removed it.",
    "twice": '"{name}" is named twice in the same {what}.',
    "no_name": "A new column needs a name.",
    "taken": 'There is already a column named "{name}".',
    "literal": '"{value}" cannot be read as a value of "{name}", which is {kind}.',
    "filter_empty": '"{name}" is empty, so there is nothing to compare. Filter it on whether it is missing instead.',
    "filter_order": '"{name}" is {kind} and cannot be ordered. Try: is, is not, or one of a list.',
    "filter_search": '"{name}" is {kind}, so it has no text to search.',
    "filter_list": '"{operator}" needs a list of values to match against.',
    "filter_single": '"{operator}" needs a single value to compare against.',
    "zero": "Dividing by zero leaves nothing to analyse.",
    "arithmetic": '"{name}" is {kind} and cannot be used in arithmetic.',
    "bin_numbers": '"{name}" is {kind}, and only numbers can be binned.',
    "bin_both": "Give cut points or a number of equal-sized buckets, not both.",
    "bin_neither": "Bins need cut points, or a number of equal-sized buckets.",
    "bin_two": "Cut points have to describe at least one bin, so there must be two.",
    "bin_increase": "Cut points have to increase.",
    "bin_count": "Between 2 and {most} buckets, not {n}.",
    "bin_labels": "There are {n} bins but {m} labels.",
    "bin_repeat": 'Two bins would both be called "{name}".',
    "bin_distinct": '"{name}" does not have enough distinct values to split into {n} buckets.',
    "date_part": '"{name}" is {kind}, so it has no {part} to read.',
    "map_kind": '"{name}" is {kind}, and only categories can be remapped.',
    "map_empty": "A mapping needs at least one value to replace.",
    "group_many": "Grouping by more than {most} columns is not offered.",
    "group_kind": '"{name}" is {kind} and cannot be grouped on. {hint}',
    "group_id": '"{name}" looks like a row identifier, so each group would hold one row.',
    "group_wide": '"{name}" has too many distinct values to group by; keep some of them, or give several one name.',
    "agg_column": '"{function}" needs a column to summarise.',
    "agg_kind": '"{name}" is {kind}, so there is no {function} of it. Try: count.',
    "agg_name": 'Two results would both be called "{name}".',
    "drop_all": "Removing every column would leave nothing to work with.",
    "rename_same": '"{name}" is already called that.',
    "cast_empty": '"{name}" has no values to convert.',
    "cast_loss": 'Reading "{name}" as {to} would turn {lost} of {had} values into gaps ({share:.0%}).',
    "fill_number": '"{name}" is {kind} and has no {method}. Try: most frequent value, or a constant.',
    "fill_empty": '"{name}" is empty, so there is no value to carry into the gaps. Fill it with a constant instead.',
    "fill_value": "Filling with a constant needs a value.",
    "compare_kind": '"{name}" is {kind}, so it has no groups to compare across.',
    "compare_id": '"{name}" looks like a row identifier, so every group would hold one row.',
    "compare_wide": '"{name}" has too many distinct values to compare across.',
    "measure": '"{name}" is {kind}, so there is nothing to {what}.',
    "relate_self": '"{name}" relates to itself perfectly, which says nothing.',
    "trend_kind": '"{name}" is {kind}, so it cannot put anything in order of time. Convert it to a date first.',
    "spread_none": '"{name}" is {kind}, and it has no spread to describe.',
    "spread_date": '"{name}" is a date column. Ask for a trend over it, or take a part of it first.',
    "compare_data": 'Fewer than two groups of "{name}" have at least {n} rows with a value.',
    "relate_data": "There are fewer than 3 rows where both have a value, or one of them never changes.",
    "trend_data": "There are fewer than 3 periods with a value to follow.",
    "apply_nothing": "A recipe with no steps changes nothing.",
    "apply_analysis": "An analysis answers with a finding, not with a table to keep.",
    "apply_rows": "This recipe leaves no rows.",
}
HINTS = {True: "Bin it into ranges first.", False: "Map its values into categories first."}
KIND_NAMES = {"numeric": "a number", "categorical": "a category", "boolean": "a yes/no column", "datetime": "a date", "text": "free text", "empty": "empty"}


class Refused(Exception):
    """A step that can't be run as asked; that is an answer, not an error."""

    def __init__(self, code: str, column: str | None = None, **told: object):
        self.code, self.column = code, column
        self.reason = REASONS[code].format(name=column, **told)
        super().__init__(self.reason)
