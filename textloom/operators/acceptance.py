"""Which annotations of blocks still hold, and what voice each block gets by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a block that took over its old annotation is marked, states of blocks that a person has to see, who needs no voice card.
REUSED, UNSURE, NARRATOR = "auto-reused", ("new", "needs-review"), "$narrator"


def judged(blocks: DataFrame, annotations: DataFrame, cards: DataFrame, by: list[str]) -> DataFrame:
    """Every block once with `state` ('accepted', 'pending', 'unknown voice'), `reason` of a pending one, and what the annotation is bound to now.

    blocks (by, kind, text_hash, context_hash, match, reason), annotations (by, speaker, text_hash, context_hash, review), one a block, cards (speaker).
    A block that was matched by itself keeps its annotation, which is bound anew. Else the annotation's text has to be the block's, for dialogue
    the context too, and one that was taken over by itself doesn't settle a block that a person has to see. Null hashes equal nothing.
    """
    own = annotations.select(*by, "speaker", F.col("text_hash").alias("_text"), F.col("context_hash").alias("_context"), F.coalesce("review", F.lit("")).alias("review"), F.lit(True).alias("_has"))
    known = cards.select("speaker").distinct().withColumn("_known", F.lit(True))
    met = blocks.select(*by, "kind", "text_hash", "context_hash", F.coalesce("match", F.lit("")).alias("match"), "reason").join(own, by, "left").join(known, "speaker", "left")
    voiced = (F.col("speaker") == NARRATOR) | F.col("_known")
    reused = F.col("match") == REUSED
    same_text, same_context = (F.coalesce(F.col(a) == F.col(b), F.lit(False)) for a, b in (("text_hash", "_text"), ("context_hash", "_context")))
    stale = ~same_text | (F.coalesce(F.col("kind") == "dialogue", F.lit(False)) & ~same_context) | (F.col("match").isin(*UNSURE) & (F.col("review") == REUSED))
    state = F.when(F.col("_has").isNull(), "pending").when(~F.coalesce(voiced, F.lit(False)), "unknown voice").when(reused | ~stale, "accepted").otherwise("pending")
    why = F.coalesce("reason", F.when(F.col("_has").isNull(), "no annotation").otherwise("text or context has changed"))
    bound = met.withColumns({"state": state, "_reused": reused})
    taken = F.col("state") == "accepted"
    return bound.select(
        *by, "kind", "speaker", "state", F.when(F.col("state") == "pending", why).alias("reason"),
        F.when(taken, F.col("text_hash")).alias("text_hash"), F.when(taken, F.when(F.col("_reused"), F.col("context_hash")).otherwise(F.col("_context"))).alias("context_hash"),
        F.when(taken, F.when(F.col("_reused"), F.lit(REUSED)).otherwise(F.col("review"))).alias("review"),
    )


def voices(accepted: DataFrame, cards: DataFrame, profiles: DataFrame, by: list[str], provider: str | None = None) -> DataFrame:
    """(by, variant, speaker, card, provider, voice, problem) of each accepted block in each variant of its narrator.

    cards (card, provider, voice); profiles (variant, card, provider, voice): the narrator is a card, or a voice of its own if card is null.
    A forced provider replaces the card's. `problem`: 'no card', 'no voice', 'no profile'. Blocks of other speakers are the same in every variant.
    """
    spoken = accepted.select(*by, "speaker")
    card = cards.select(F.col("card").alias("_card"), F.col("provider").alias("_provider"), F.col("voice").alias("_voice"), F.lit(True).alias("_there"))
    told = profiles.select("variant", F.col("card").alias("_profile"), F.col("provider").alias("_own_provider"), F.col("voice").alias("_own_voice"))
    narrated = spoken.filter(F.col("speaker") == NARRATOR).join(told.withColumn("_who", F.lit(NARRATOR)), F.col("speaker") == F.col("_who"), "left")
    spoken = spoken.filter(F.col("speaker") != NARRATOR).select(*by, "speaker", F.lit(None).cast("string").alias("variant"), F.col("speaker").alias("_profile"), *(F.lit(None).cast("string").alias(c) for c in ("_own_provider", "_own_voice")))
    met = narrated.select(spoken.columns).unionByName(spoken).join(card, F.col("_profile") == F.col("_card"), "left")
    of_card = F.col("_profile").isNotNull()
    problem = F.when((F.col("speaker") == NARRATOR) & F.col("variant").isNull(), "no profile").when(of_card & F.col("_there").isNull(), "no card").when(F.when(of_card, F.col("_voice")).otherwise(F.col("_own_voice")).isNull(), "no voice")
    return met.select(
        *by, "variant", "speaker", F.coalesce("_card", F.when(~of_card & F.col("variant").isNotNull(), F.concat(F.lit(NARRATOR + ":"), "variant"))).alias("card"),
        F.coalesce(F.lit(provider), F.when(of_card, F.col("_provider")).otherwise(F.coalesce("_own_provider", F.lit("edge")))).alias("provider"),
        F.when(of_card, F.col("_voice")).otherwise(F.col("_own_voice")).alias("voice"), problem.alias("problem"),
    )
