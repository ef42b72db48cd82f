"""Named common table expressions and the queries put together from them."""

from __future__ import annotations

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """Register a table expression; it may use those registered before it."""
    CTES[name] = sql.strip()


def query(tail: str, *names: str) -> str:
    """A statement with the table expressions ``tail`` needs, in the order registered."""
    needed = set(names)
    queue = [tail, *(CTES[n] for n in names)]
    while queue:
        text = queue.pop()
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())
        for name in CTES:
            if name in words and name not in needed:
                needed.add(name)
                queue.append(CTES[name])
    parts = ",\n".join(f"{name} AS MATERIALIZED (\n{CTES[name]}\n)" for name in CTES if name in needed)
    return f"WITH {parts}\n{tail.strip()}" if parts else tail.strip()


def literal(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"
