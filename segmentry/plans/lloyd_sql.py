"""SQL text of hash-seeded Lloyd steps, for checking the fixed-step fit."""

from __future__ import annotations

from segmentry.plans.fixtures import draw_sql


def lloyd_ctes(source: str, k: int, iterations: int, seed: int) -> str:
    """CTEs ``c0 .. c<n>`` (cluster, c) and ``assigned`` (row_id, cluster, d) over ``source(row_id, v)``."""
    out = [f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {draw_sql(seed, 'kmeans-seed', 'row_id')}) - 1 AS cluster, v AS c
      FROM {source} ORDER BY {draw_sql(seed, 'kmeans-seed', 'row_id')} LIMIT {k})"""]

    def nearest(i: int) -> str:
        return (f"SELECT row_id, any_value(v) AS v, arg_min(cluster, d) AS cluster, min(d) AS d FROM ("
                f"SELECT s.row_id, s.v, t.cluster, list_distance(s.v, t.c) AS d FROM {source} s, c{i} t) GROUP BY row_id")

    for i in range(iterations):
        out.append(f"a{i} AS MATERIALIZED ({nearest(i)})")
        out.append(f"""c{i + 1} AS MATERIALIZED (SELECT cluster, list(m ORDER BY dim) AS c FROM (SELECT cluster, dim, avg(x) AS m FROM (
          SELECT cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM a{i}) GROUP BY 1, 2) GROUP BY 1)""")
    out.append(f"assigned AS MATERIALIZED ({nearest(iterations)})")
    return ", ".join(out)
