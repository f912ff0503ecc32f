"""Where queries put their names."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

#: Views that the SQL versions share.
VIEWS = {
    "raster": "SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS r, ((i - 1) % 8)::INT AS c, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)",
    "labels_r": "SELECT image_id, r, c, floor(abs(v) * 10)::INT AS label FROM raster",
    "predicted_r": "SELECT image_id, r, c, floor(abs(v) * 10 + 0.3)::INT AS label FROM raster",
    "rgb": "SELECT image_id, r, c, floor((v + 1) * 127)::BIGINT AS red, floor(abs(v) * 255)::BIGINT AS green, ((r * 8 + c) * 4)::BIGINT AS blue FROM raster",
    "dist_u": "SELECT image_id, r, c, label, exp(3 * v * label)::DOUBLE AS p FROM raster, (SELECT unnest(range(0, 4)) AS label)",
    "points": "SELECT vec_id AS id, embedding AS data, label FROM embeddings",
    "hist": "SELECT user_id AS hist_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS tree, (floor(abs(value))::BIGINT % 15) + 1 AS idx, count(*)::DOUBLE AS value FROM events GROUP BY ALL",
    "ranking": "SELECT d.doc_id AS id, d.n_chars::DOUBLE AS rank, l.quality = 1 AS positive FROM documents d JOIN labels l USING (doc_id)",
}


def needed(sql: str) -> list[str]:
    found: list[str] = []

    def add(text: str) -> None:
        import re

        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in found:
                add(body) if body is not text else None
                if name not in found:
                    found.append(name)

    add(sql)
    return found


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, and its SQL, to which the shared views that it names are added."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            with_ = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed(sql))
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE "):
                ORACLE[name] = f"WITH RECURSIVE {with_}, {body[15:]}" if with_ else body
            elif body.upper().startswith("WITH "):
                ORACLE[name] = f"WITH {with_}, {body[5:]}" if with_ else body
            else:
                ORACLE[name] = f"WITH {with_} {body}" if with_ else body
        return f

    return put
