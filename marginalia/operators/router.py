"""Routing of user input by rules: command, note to open, search of notes, or general chat; and the target of density questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import words
from marginalia.functions.columns import any_substring, let, present


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def command(norm: Column) -> Column:
    """struct(name, reason); a null name for no command. norm: normalized input."""
    slash, phrase = _lookup(norm, words.SLASH_COMMANDS), _lookup(norm, words.COMMAND_PHRASES)
    promote = F.lit("eval_promote")
    cases = (
        (slash.isNotNull(), slash, "explicit slash command"),
        (norm.startswith("/eval-promote"), promote, "explicit slash command with arguments"),
        (phrase.isNotNull(), phrase, "natural-language command phrase"),
        (norm.startswith("promote eval candidates"), promote, "natural-language command phrase with arguments"),
    )
    name, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, n, r in reversed(cases):
        name, reason = F.when(cond, n).otherwise(name), F.when(cond, F.lit(r)).otherwise(reason)
    return F.struct(name.alias("name"), reason.alias("reason"))


def path_hint(norm: Column) -> Column:
    """The note path that input asks to open, or null."""
    forward = F.translate(norm, "\\", "/")
    return F.coalesce(*[F.nullif(T.clean_path_hint(F.regexp_extract(forward, p, 1)), F.lit("")) for p in words.OPEN_PATHS])


def result_index(norm: Column) -> Column:
    """The number of the search result that input asks to open, or null; the first pattern that matches decides."""
    first, second = (F.regexp_extract(norm, p, 1) for p in words.OPEN_RESULTS)
    return F.when(first != "", T.ordinal(first)).when(second != "", T.ordinal(second))


def search_signals(norm: Column) -> Column:
    """Reasons to search notes, in order."""
    phrase = F.lit(None).cast("string")
    for p in reversed(words.SEARCH_PHRASES):
        phrase = F.when(norm.contains(p), F.lit(f"matched phrase '{p}'")).otherwise(phrase)
    noun = norm.rlike(words.NOUNS)
    return present(
        phrase, F.when(norm.rlike(words.PERSONAL_MEMORY), F.lit("personal memory wording")),
        F.when(noun & norm.rlike(words.SEARCH_VERBS), F.lit("notes noun + search wording")),
        F.when(norm.startswith("find ") & noun, F.lit("find query aimed at files or notes")),
    )


def route(text: Column) -> Column:
    """struct(mode, confidence, reasons, command_name, note_path_hint, note_result_index)."""
    def decide(norm: Column) -> Column:
        parts = F.struct(command(norm).alias("cmd"), path_hint(norm).alias("path"), result_index(norm).alias("index"), search_signals(norm).alias("signals"))

        def pick(x: Column) -> Column:
            is_cmd = x["cmd"]["name"].isNotNull()
            by_path, by_index = ~is_cmd & x["path"].isNotNull(), ~is_cmd & x["path"].isNull() & x["index"].isNotNull()
            opens, searches = by_path | by_index, F.size(x["signals"]) > 0
            return F.struct(
                F.when(is_cmd, "command").when(opens, "note_open").when(searches, "notes_search").otherwise("general_chat").alias("mode"),
                F.when(is_cmd, 1.0).when(opens, 0.92).when(searches, 0.85).otherwise(0.65).alias("confidence"),
                F.when(is_cmd, F.array(x["cmd"]["reason"])).when(by_path, F.array(F.lit("explicit note open request"))).when(by_index, F.array(F.lit("follow-up note open request")))
                .when(searches, x["signals"]).otherwise(F.array(F.lit("defaulted to general chat"))).alias("reasons"),
                x["cmd"]["name"].alias("command_name"), F.when(by_path, x["path"]).alias("note_path_hint"), F.when(by_index, x["index"]).alias("note_result_index"),
            )

        return let(parts, pick)

    return let(T.normalize(F.coalesce(text, F.lit(""))), decide)


def density_target(text: Column) -> Column:
    """What a density question counts, or null if it is none."""
    low = F.lower(text)
    asks = any_substring(low, ("which file", "what file")) & any_substring(low, ("a lot", "lots", "many", "most", "highest", "top"))
    kind = (
        F.when(low.contains("ip address") | low.rlike(r"\bips?\b"), "ip").when(low.contains("email address") | low.rlike(r"\bemails?\b"), "email")
        .when(low.rlike(r"\b(urls?|links?|websites?)\b"), "url").when(any_substring(low, ("api key", "access key")), "api_key")
        .when(any_substring(low, ("credit card", "card number")), "credit_card").when(any_substring(low, ("sql", "query", "queries", "statement")), "sql")
    )
    return F.when(asks, kind)
