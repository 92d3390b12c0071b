"""History strings, description choice and prompt wording. All wording is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.text import strip

LIST_JSON = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def parse_list(text: Column | str) -> Column:
    """A list written as source text, such as ['a', "b"], to an array; null when it is not one."""
    return F.from_json(text, "array<string>", LIST_JSON)


def history_key(history: Column | str) -> Column:
    return F.array_join(history, "::")


def history_text(history: Column | str) -> Column:
    return F.array_join(history, ", ")


def quoted_history(titles: Column | str, separator: str = ", ") -> Column:
    """Titles in double quotes; training prompts separate them by comma and tab, others by comma and blank."""
    return F.array_join(F.transform(titles, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), separator)


def longest_description(description: Column | str, title: Column | str) -> Column:
    """Plain text as it is, a list as its longest non-blank element (the first of equals), else the title."""
    text = F.col(description) if isinstance(description, str) else description
    name = F.col(title) if isinstance(title, str) else title
    listed = text.startswith("[") & text.endswith("]")
    parsed = F.when(listed, parse_list(text))
    usable = F.filter(parsed, lambda d: d.isNotNull() & (strip(d) != ""))
    ranked = F.transform(usable, lambda d, i: F.struct(F.length(d).alias("n"), (-i).alias("p"), d.alias("d")))
    plain = F.when(strip(text) != "", text).otherwise(name)
    return F.coalesce(
        F.when(text.isNull() | (text == ""), name),
        F.when(listed & parsed.isNotNull(), F.coalesce(F.array_max(ranked)["d"], name)),
        plain,
    )


def first_description(description: Column | str) -> Column:
    """The first element of text of the form ['...'] or ["..."], any other text unchanged."""
    text = F.col(description) if isinstance(description, str) else description
    listed = (text.startswith("['") & text.endswith("']")) | (text.startswith('["') & text.endswith('"]'))
    return F.coalesce(F.when(listed, F.get(parse_list(text), F.lit(0))), text)


def fill(template: str, **parts: Column) -> Column:
    """Template with {name} slots as one concatenation, so values with % or braces are safe."""
    pieces, rest = [], template
    while rest:
        start = rest.find("{")
        if start < 0:
            pieces.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            pieces.append(F.lit(rest[:start]))
        pieces.append(parts[rest[start + 1:end]])
        rest = rest[end + 1:]
    return F.concat(*pieces)


# Default wording, ours to choose: callers pass their own templates.
FRAME = "### User Input:\n{question}\n\n### Response:\n"
PREAMBLE = "Follow the instruction below, using the input that comes with it.\n\n### Instruction:\n{instruction}\n\n"
NEXT_ITEM_INSTRUCTIONS = [
    "Suggest the next {category} this user is likely to choose.",
    "Read the user's recent {category} and name one they would pick next.",
    "Continue the user's list of {category} with a fitting one.",
    "From the {category} the user liked lately, infer what follows.",
    "Name a {category} that suits the taste shown in the history.",
    "Work out which {category} this person will want after these.",
    "Given what was enjoyed so far, recommend one more {category}.",
    "Choose the {category} that best extends this history.",
    "Look at the sequence of {category} and predict the next entry.",
    "Tell which {category} should come after the ones listed.",
    "Use the listed {category} to guess the user's next choice.",
]
INTENT_PROMPT = (
    "A customer bought the {category} item \"{title}\" and wrote:\n\"{review}\"\n"
    "Describe, in the first person, what the customer prefers and what the item is like, without its title."
)
PREFERENCE_PROMPT = (
    "A customer bought these {category} items in order:\n{titles}.\nAfterwards they chose: {target}. "
    "Summarise in the third person what this shows about their preferences, without naming the last item."
)
