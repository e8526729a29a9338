"""Headline timings: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import (  # noqa: E402
    CLASSES,
    DOC_CLEAN,
    DOC_FEATURES,
    LEXICON,
    REVIEW_CLEAN,
    corpus,
    documents,
    fresh_path,
    lexicon_polarity,
    reviews,
)
from sentilake.operators import cleaning, features, models, scoring, splitting  # noqa: E402
from sentilake.plans import jobs  # noqa: E402
from sentilake.session import local_session  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        result = action()
        timings[name] = round(time.perf_counter() - start, 3)
        return result

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    docs = documents(spark, sf).select("doc_id", "text")
    drain(docs)  # start the JVM's reader before the clock runs
    timed("clean_reviews", lambda: drain(cleaning.clean_reviews(docs, DOC_CLEAN)))
    timed("dedup_text", lambda: drain(cleaning.first_per_text(docs, "text", "doc_id")))
    timed("lexicon_polarity", lambda: drain(lexicon_polarity(spark, sf)))

    # As in the train job, features and models read the cleaned table, not the raw text.
    path = fresh_path(spark, "bench-cleaned")
    timed("write_cleaned", lambda: corpus(spark, sf).write.parquet(path))
    train = spark.read.parquet(path)
    timed("stratified_split", lambda: drain(splitting.assign_split(train, "doc_id", "sentiment")))
    tfidf = timed("fit_tfidf", lambda: features.fit_tfidf(train, DOC_FEATURES))
    timed("tfidf_long", lambda: drain(features.tfidf_long(train, tfidf)))
    timed("tfidf_vectors", lambda: drain(features.vectorize(train, tfidf)))
    model = timed("fit_naive_bayes", lambda: models.fit_naive_bayes(train, tfidf, CLASSES))

    timed("score_documents", lambda: drain(scoring.score_reviews(docs, model, LEXICON, DOC_CLEAN, words=False)))
    timed("score_documents_words", lambda: drain(scoring.score_reviews(docs, model, LEXICON, DOC_CLEAN)))
    # The derived reviews are written first: their making is no part of the jobs.
    derived = fresh_path(spark, "bench-reviews")
    reviews(spark, sf).write.parquet(derived)
    rows = spark.read.parquet(derived)
    timed("annotate_reviews", lambda: drain(jobs.annotate(rows, model, LEXICON, REVIEW_CLEAN)))
    timed("review_page", lambda: jobs.score_page(rows, model, 50, 10, LEXICON, REVIEW_CLEAN).rows.collect())

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf.rstrip("/")),
                "documents_per_second": round(docs.count() / timings["score_documents"], 1),
                "reviews_per_second": round(rows.count() / timings["annotate_reviews"], 1),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
