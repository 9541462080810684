"""Prompt guards as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks around a retrieved chunk.
DOC_START, DOC_END = "<|doc_start|>", "<|doc_end|>"
#: Fixed values: (pattern, weight, name) of injection signs, and the score from which an input is rejected.
INJECTION = [
    (r"(?i)\b(ignore|forget|disregard)\b.{0,30}\b(previous|above|all|instructions?|context|rules?|prompt)\b", 3, "instruction override"),
    (r"(?i)\bsystem prompt\b", 3, "system prompt probe"),
    (r"(?i)\b(override|replace|rewrite)\b.{0,20}\b(instructions?|rules?|prompt|behavior)\b", 3, "instruction replacement"),
    (r"(?i)\bdo not\b.{0,30}\b(follow|obey|listen|use)\b", 2, "instruction negation"),
    (r"(?i)\b(this is fake|that was wrong|correction|addendum)\b", 2, "context manipulation"),
    (r"(?i)\bnew (task|role|instructions?)\b", 2, "task switching"),
    (r"(?i)\b(ps:|p\.s\.:?|postscript)\b", 1, "postscript injection"),
    (r"(?i)\binstead of\b.{0,20}\b(answering|following|using)\b", 2, "alternative instruction"),
]
REJECT_FROM = 3
#: Signs in an answer that an injection worked.
SUSPICIOUS = [r"(?i)ignore.*instructions?", r"(?i)forgot.*context", r"(?i)new task", r"(?i)malicious|attack|injection", r"(?i)outside.*context|beyond.*context", r"(?i)system prompt.*is"]


def injection_score(c: Column) -> Column:
    """Sum of the weights of the patterns that occur; each counts once."""
    out = F.lit(0)
    for p, w, _ in INJECTION:
        out = out + F.when(c.rlike(p), w).otherwise(0)
    return out


def injection_names(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike(p), name) for p, _, name in INJECTION]))


def injection_reason(c: Column) -> Column:
    """Why an input is rejected; null if it isn't."""
    score = injection_score(c)
    text = F.concat(F.lit("injection patterns detected (score "), score.cast("string"), F.lit(f"/{REJECT_FROM}): "), F.array_join(injection_names(c), ", "))
    return F.when(score >= REJECT_FROM, text)


def sanitize(c: Column) -> Column:
    """Marks, dashes and fences are escaped line by line; the end is trimmed."""
    from weftlake.functions.text import WS, lines

    x = F.array_join(lines(c), "\n")
    for a in (DOC_START, DOC_END):
        x = F.replace(x, F.lit(a), F.lit("\\" + a))
    x = F.replace(x, F.lit("---"), F.lit(r"\-\-\-"))
    x = F.replace(x, F.lit("```"), F.lit(r"\`\`\`"))
    return F.regexp_replace(x, f"[{WS}]+$", "")


def suspicious(c: Column) -> Column:
    """Whether an answer shows signs that an injection worked."""
    out = F.lit(False)
    for p in SUSPICIOUS:
        out = out | c.rlike(p)
    return out


def escape_title(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def chunk_block(number: Column, title: Column, score: Column, content: Column) -> Column:
    """One retrieved chunk between its marks."""
    return F.concat(
        F.lit(f"{DOC_START}\n[Chunk "), number.cast("string"), F.lit("] - "), escape_title(title), F.lit("\nSimilarity Score: "), F.format_string("%.2f", score), F.lit("\nContent:\n"), content, F.lit(f"\n{DOC_END}")
    )
