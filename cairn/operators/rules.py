"""Decision rules as columns: suitability, explanations, cursors and states, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import fold

# What marks a game as for adults only.
ADULT_DESCRIPTOR = 3
ADULT_GENRES = ["Sexual Content", "Nudity"]
ADULT_TAGS = ["NSFW", "Hentai", "Sexual Content", "Nudity"]
ADULT_TAG_SHARE, ADULT_TOP_TAG_SHARE = 0.17, 0.10
ADULT_WORDS = ["hentai\\w*", "nsfw", "porn\\w*", "sex", "sexy\\w*", "sexual", "sexbot\\w*", "lewd\\w*", "erotic\\w*", "eroge", "ecchi", "oppai", "nude", "nudes", "nudity", "naked", "milfs?", "futa\\w*", "ahegao", "boob\\w*", "busty", "horny", "stripteas\\w*", "strippers?", "strip poker", "r18", "18\\+"]

# Sentences of explanations that are made from the data.
SENTENCES = {
    "en": ["Because you liked {game}, from the same studio ({studio}).", "Because you liked {game}, which is also {genre}.", "Because you liked {game}.", "Fits your taste for {genre} games.", "Recommended from your reviews."],
    "es": ["Porque te gustó {game}, del mismo estudio ({studio}).", "Porque te gustó {game}, que también es de {genre}.", "Porque te gustó {game}.", "Encaja con tu gusto por los juegos de {genre}.", "Recomendado a partir de tus reseñas."],
}


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def adult_name(name: Column, words: list[str] = ADULT_WORDS) -> Column:
    return _known(name.rlike(rf"(?i)\b(?:{'|'.join(words)})(?!\w)"))


def adult_genres(genres: Column, marked: list[str] = ADULT_GENRES) -> Column:
    return _known(F.arrays_overlap(genres, F.array(*map(F.lit, marked))))


def adult_votes(names: Column, weights: Column, marked: list[str] = ADULT_TAGS) -> Column:
    """By the marked tags' share of the votes, or a smaller one if a marked tag has the most. weights: of the names, place by place."""
    own = F.zip_with(names, weights, lambda n, w: F.when(n.isin(marked), w.cast("double")).otherwise(0.0))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    share = F.try_divide(total(own), total(weights))
    on_top = (F.array_max(own) > 0) & (F.array_max(own) >= F.array_max(weights))
    return _known((share >= ADULT_TAG_SHARE) | ((share >= ADULT_TOP_TAG_SHARE) & on_top))


def adult(name: Column, genres: Column, tags: Column, weights: Column, descriptors: Column, words: list[str] = ADULT_WORDS, marked_genres: list[str] = ADULT_GENRES, marked_tags: list[str] = ADULT_TAGS, descriptor: int = ADULT_DESCRIPTOR) -> Column:
    """Any of four signs."""
    return adult_name(name, words) | adult_genres(genres, marked_genres) | adult_votes(tags, weights, marked_tags) | _known(F.array_contains(descriptors, descriptor))


def looks_released(release: Column, has_reviews: Column, today: Column) -> Column:
    return _known(has_reviews) | _known(release < today)


# Explanations. Games are structs of name, developers, genres, tags; text and names are folded before they are compared.


def _whole(name: Column) -> Column:
    return F.concat(F.lit(r"(?<!\w)\Q"), name, F.lit(r"\E(?!\w)"))


def names_candidate(text: Column, candidate: Column, liked: Column) -> Column:
    """Does a text name the candidate itself? Liked names go first, the longest before others: one may hold the candidate's."""
    longest = F.transform(F.array_sort(F.transform(liked, lambda g, i: F.struct((-F.char_length(g["name"])).alias("n"), i.alias("i"), fold(g["name"]).alias("name")))), lambda x: x["name"])
    rest = F.aggregate(F.filter(longest, lambda n: n != ""), fold(text), lambda t, n: F.regexp_replace(t, _whole(n), F.lit(" ")))
    name = fold(candidate["name"])
    return (name != "") & F.regexp_like(rest, _whole(name))


def grounded(text: Column, candidate: Column, liked: Column) -> Column:
    """Does a text name a liked game, or a developer, tag or genre of one or of the candidate? Terms of fewer than three letters don't count."""
    of = lambda g: F.concat(g["developers"], g["tags"], g["genres"])
    terms = F.concat(F.transform(liked, lambda g: g["name"]), of(candidate), F.flatten(F.transform(liked, of)))
    terms = F.filter(F.array_distinct(F.transform(terms, fold)), lambda t: F.char_length(t) >= 3)
    folded = fold(text)
    return F.exists(terms, lambda t: F.regexp_like(folded, _whole(t)))


def explanation_problem(text: Column, candidate: Column, liked: Column, most: int) -> Column:
    """Why an explanation is rejected, or null."""
    return F.when(F.char_length(text) > most, "too long").when(names_candidate(text, candidate, liked), "names the candidate").when(~grounded(text, candidate, liked), "not grounded")


def template_explanation(candidate: Column, liked: Column, language: str = "en") -> Column:
    """A sentence from the data: the first liked game that shares a developer, or else a genre; else the first liked; else the candidate's first genre."""
    studio, genre, only, taste, reviews = SENTENCES[language]
    shared = lambda a, b: F.get(F.filter(a, lambda x: F.array_contains(b, x)), F.lit(0))
    seen = F.transform(liked, lambda g: F.struct(g["name"].alias("name"), shared(g["developers"], candidate["developers"]).alias("studio"), shared(g["genres"], candidate["genres"]).alias("genre")))
    first = F.get(F.filter(seen, lambda x: x["studio"].isNotNull() | x["genre"].isNotNull()), F.lit(0))
    fill = lambda s, **k: _filled(s, k)
    return (
        F.when(first["studio"].isNotNull(), fill(studio, game=first["name"], studio=first["studio"])).when(first["genre"].isNotNull(), fill(genre, game=first["name"], genre=first["genre"]))
        .when(F.size(liked) > 0, fill(only, game=F.get(liked, F.lit(0))["name"])).when(F.size(candidate["genres"]) > 0, fill(taste, genre=F.get(candidate["genres"], F.lit(0)))).otherwise(reviews)
    )


def _filled(sentence: str, values: dict[str, Column]) -> Column:
    out = F.lit(sentence)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


# Cursors and states: conditional updates are guarded columns, so a rerun changes nothing.


def backfill_pending(oldest: Column, complete: Column) -> Column:
    return oldest.isNotNull() & ~_known(complete)


def backfill_budget(pending: Column, stored: Column, per_run: int, most: int) -> Column:
    """What one run may fetch; an unknown stored count has no cap, nor has most = 0."""
    left = F.greatest(F.lit(0), F.least(F.lit(per_run), most - stored)) if most else F.lit(per_run)
    return F.when(~pending, 0).otherwise(F.coalesce(left, F.lit(per_run))).cast("long")


def seeded(oldest: Column, complete: Column, found_oldest: Column, found: Column, total: Column) -> tuple[Column, Column]:
    """(oldest, complete) after seeding: only where a cursor has neither. Without anything found there is nothing older to fetch."""
    empty = oldest.isNull() & complete.isNull()
    enough = F.when(found.isNull(), True).otherwise(found >= F.coalesce(total, F.lit(0)))
    return F.when(empty, found_oldest).otherwise(oldest), F.when(empty, enough).otherwise(complete)


def reopened(oldest: Column, complete: Column, stored: Column, found: Column, total: Column, most: int, slack: int = 100, slack_ratio: float = 0.01) -> Column:
    """The stored count with which a backfill that only seems complete is opened again, or null: not if the cap ended it, nor if what was found is all there is but for some slack."""
    have = F.coalesce(found, F.lit(0))
    capped = (F.coalesce(stored, have) >= most) if most else F.lit(False)
    exhausted = total.isNull() | (total - have <= F.greatest(F.lit(slack), F.floor(total * slack_ratio)))
    return F.when(_known(complete) & oldest.isNotNull() & ~capped & ~exhausted, have)


def requeued(status: Column) -> Column:
    """Only what was scraped goes back."""
    return F.when(status == "scraped", "pending").otherwise(status)


def after_failure(status: Column, attempts: Column, most: int) -> tuple[Column, Column]:
    """(status, attempts) after one more failed attempt; the last one ends what is pending."""
    n = F.coalesce(attempts, F.lit(0)) + 1
    return F.when((n >= most) & (status == "pending"), "failed").otherwise(status), n


def publish_due(stored: Column, wanted: Column, published_at: Column, now: Column, days: int) -> Column:
    """Without a state, or with one of another dataset, at once; else after some days."""
    return stored.isNull() | (stored != wanted) | (now - F.make_dt_interval(F.lit(days)) >= published_at)


# Gates


def promotion(score: Column, champion: Column, floor: Column, gain: float) -> Column:
    """What to do with a candidate: it must beat the baseline, and the champion by more than a gain."""
    return F.when(score.isNull(), "no metric").when(score <= floor, "not above the baseline").when(champion.isNull(), "first champion").when(score > champion + gain, "better than the champion").otherwise("gain too small")


def pair_promotion(runs: DataFrame, challengers: DataFrame, max_reach: float, retriever_gain: float, gain: float) -> DataFrame:
    """(run, winner, reason): the challenger pair that may replace the serving pair of a run.

    runs (run, changed, reach, new_recall, old_recall, new_ceiling, old_ceiling, recall, ndcg):
    the retriever's figures if it changed, and the serving pair's. challengers (run, pair,
    reach, recall, ndcg), pairs in order. A reach that is unknown floods nothing.
    """
    c = challengers.withColumn("floods", _known(F.col("reach") > max_reach))
    per = c.groupBy("run").agg(F.count_if(~F.col("floods")).alias("usable"), F.min_by(F.struct("pair", "recall", "ndcg"), F.when(~F.col("floods"), F.struct(-F.col("recall"), -F.col("ndcg"), F.col("pair")))).alias("best"))
    r = runs.join(per, "run", "left")
    better = (F.col("best.recall") > F.col("recall") + gain) & (F.col("best.ndcg") >= F.col("ndcg"))
    reason = (
        F.when(F.col("changed") & _known(F.col("reach") > max_reach), "one item in too many lists").when(F.col("changed") & ~(F.col("new_recall") > F.col("old_recall") + retriever_gain), "retrieval not better").when(F.col("changed") & (F.col("new_ceiling") < F.col("old_ceiling")), "ceiling fell")
        .when(F.coalesce("usable", F.lit(0)) == 0, "every challenger floods").when(better, "better").otherwise("final lists not better")
    )
    return r.withColumn("reason", reason).select("run", F.when(F.col("reason") == "better", F.col("best.pair")).alias("winner"), "reason")


def rollback(history: DataFrame, run: str, at: str, action: str, pair: str) -> DataFrame:
    """(run, pair) to go back to: of an append-only history of promotions and rollbacks the pair that was live before the one that is now."""
    live = history.filter(F.col(action).isin("promote", "rollback"))
    w = Window.partitionBy(run).orderBy(F.col(at).desc())
    return live.withColumn("__now", F.first(pair).over(w)).filter(F.col(pair) != F.col("__now")).withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(run, pair)
