"""The one exception raised when a request cannot be answered safely."""

from __future__ import annotations


class QueryIssue(ValueError):
    """A request that is refused at plan time, before any result job starts.

    ``issues`` lists every problem found; ``schema`` describes the tables so that
    the caller can show what could have been asked instead.
    """

    def __init__(self, summary: str, issues: list[str] | None = None, schema: str = "") -> None:
        self.summary = summary
        self.issues = list(issues or [summary])
        self.schema = schema
        super().__init__(f"{summary} {'; '.join(self.issues)}" if issues else summary)

    @property
    def questions(self) -> list[str]:
        return list(self.issues)

    def as_row(self) -> dict[str, object]:
        """The refusal as a result row, for callers that expect rows only."""
        asked = "\n".join(f"- {question}" for question in self.questions)
        return {
            "_summary": f"{self.summary}\n{asked}\n\n{self.schema}".rstrip(),
            "should_ask_user": True,
        }
