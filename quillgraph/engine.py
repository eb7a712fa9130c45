"""Running statements: text or builder, reads and mutations, scripts, pages."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .builder import Pattern
from .catalog import Graph
from .errors import BudgetExceeded, StaleCursor
from .gql import parse, split_script
from .model import Query
from .operators import mutate
from .plans.compiler import Compiler, Result

PAGE_MAX = 500


class Engine:
    """A graph snapshot with its compiler; mutations move it to a new snapshot."""

    def __init__(self, graph: Graph, row_budget: int | None = None, **options):
        self.graph, self.options, self.row_budget = graph, options, row_budget

    def compiler(self) -> Compiler:
        return Compiler(self.graph, **self.options)

    def execute(self, statement, params: dict | None = None) -> Result:
        if isinstance(statement, str):
            statement = parse(statement, params)
        if isinstance(statement, Pattern):
            statement = statement.build()
        if isinstance(statement, Query):
            out = self.compiler().run(statement)
            if self.row_budget is not None and out.rows.limit(self.row_budget + 1).count() > self.row_budget:
                raise BudgetExceeded(f"more than {self.row_budget} rows")
            return out
        # the new snapshot shows only once the whole statement has been planned
        snapshot, rows = mutate.apply(self.graph, statement, self.compiler())
        self.graph = snapshot
        return Result(rows)

    def rows(self, statement, params: dict | None = None) -> DataFrame:
        return self.execute(statement, params).rows

    def rows_of(self, query: Query) -> DataFrame:
        """The rows of a logical query."""
        return self.compiler().run(query).rows

    def transaction(self):
        """Statements that the engine sees only once they are committed."""
        from .transactions import Transaction

        return Transaction(self)

    def script(self, text: str, params: dict | None = None, stop_on_error: bool = True) -> list:
        """Statements one after another; a failed one leaves the snapshot as it was."""
        out = []
        for s in split_script(text):
            try:
                out.append(self.execute(s, params))
            except Exception as e:  # noqa: BLE001
                if stop_on_error:
                    raise
                out.append(e)
        return out

    def page(self, statement, size: int = PAGE_MAX, token: str | None = None, params: dict | None = None):
        """(rows, next token): at most ``size`` rows as a list, one more looked at. A token
        holds its plan's hash and the snapshot's revision."""
        q = parse(statement, params) if isinstance(statement, str) else statement.build()
        plan = hashlib.sha256(json.dumps(self.compiler().explain(q, self.compiler().bind(q)), default=str).encode()).hexdigest()
        at = 0
        if token:
            try:
                held = json.loads(base64.urlsafe_b64decode(token))
                good = hashlib.sha256(f"{held['plan']}{held['revision']}{held['at']}".encode()).hexdigest() == held["check"]
            except (ValueError, KeyError, TypeError) as e:
                raise StaleCursor("the token can't be read") from e
            if not good or held["plan"] != plan or held["revision"] != self.graph.revision:
                raise StaleCursor("the token belongs to another plan or snapshot")
            at = held["at"]
        size = min(size, PAGE_MAX)
        rows = self.compiler().run(q).rows
        if not q.order:
            rows = rows.orderBy(*[c for c, k in rows.dtypes if not k.startswith("map")])
        got = rows.offset(at).limit(size + 1).collect()  # one page
        if len(got) <= size:
            return got, None
        nxt = {"plan": plan, "revision": self.graph.revision, "at": at + size}
        nxt["check"] = hashlib.sha256(f"{nxt['plan']}{nxt['revision']}{nxt['at']}".encode()).hexdigest()
        return got[:size], base64.urlsafe_b64encode(json.dumps(nxt).encode()).decode()

    def observed(self, statement, params: dict | None = None):
        """Rows with a running count of them: (DataFrame, Observation)."""
        from pyspark.sql import Observation

        seen = Observation("rows")
        return self.rows(statement, params).observe(seen, F.count(F.lit(1)).alias("rows")), seen
