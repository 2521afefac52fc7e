"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder with the tables, BENCH_CPUS the task slots.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opinara.operators import corpus, ranking, regression, text  # noqa: E402
from opinara.operators.robust import RobustPlsa  # noqa: E402
from opinara.operators.topics import Plsa  # noqa: E402
from opinara.plans import experiments, queries  # noqa: E402
from opinara.session import build_session  # noqa: E402

ROUNDS = 3


def run(frame):
    """Compute every row and column, keep none."""
    frame.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="opinara-bench-")
    spark = build_session(
        "opinara-bench",
        cpus,
        os.environ.get("BENCH_MEMORY", "12g"),
        **{"spark.checkpoint.dir": f"{work}/shared", "spark.sql.warehouse.dir": f"{work}/warehouse"},
    )
    docs = queries.texts(spark, folder)
    points, centers = queries.points(spark, folder), queries.centers(spark, folder)
    state = {}

    def build():
        state["corpus"] = corpus.build_corpus(docs)

    def fit(name, trainer):
        state[name] = trainer.fit(state["corpus"])

    steps = {
        "token_counts": lambda: run(text.token_counts(docs)),
        "vocabulary": lambda: run(corpus.build_vocabulary(text.frequent_tokens(docs)).frame),
        "corpus": build,
        f"plsa_{ROUNDS}_rounds": lambda: fit("plsa", Plsa(5, ROUNDS)),
        f"robust_{ROUNDS}_rounds": lambda: fit("robust", RobustPlsa(5, ROUNDS)),
        "plsa_fold_in": lambda: run(state["plsa"].transform(queries.new_texts(spark, folder)).theta),
        "hashed_tf": lambda: run(text.hashed_tf(docs)),
        "gradient_12_steps": lambda: regression.train_by_gradient(
            regression.packed_tf(queries.labelled(spark, folder)).join(
                queries.labelled(spark, folder).select("doc_id", "label"), "doc_id"
            ),
            step=0.001,
        ),
        "nearest_center": lambda: run(ranking.nearest_center(points, centers)),
        "closest_nth_points": lambda: run(ranking.closest_nth_points(points, centers, 3)),
        "kmeans_reviews": lambda: run(queries.kmeans_reviews_rows(spark, folder)),
        "lda_reviews": lambda: run(queries.lda_reviews_rows(spark, folder)),
        "useful_models": lambda: run(experiments.train_useful(queries.reviews(spark, folder)).metrics),
        "kmeans_tfidf": lambda: run(queries.kmeans_tfidf_rows(spark, folder)),
    }
    seconds = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
