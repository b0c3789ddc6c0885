"""The settings of a deployment in one immutable object."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from ledgerloom.operators import ask, evidence, model_stage, retrieve


@dataclass(frozen=True)
class Options:
    vector_k: int = retrieve.VECTOR_K
    lexical_k: int = retrieve.LEXICAL_K
    final_k: int = retrieve.FINAL_K
    threshold: float = retrieve.THRESHOLD
    question_k: int = ask.QUESTION_K
    coverage: float = evidence.COVERAGE
    attempts: int = model_stage.ATTEMPTS
    first_wait: float = model_stage.FIRST_WAIT
    longest_wait: float = model_stage.LONGEST_WAIT
    lake_root: str = ""
    broker: str = ""
    topic: str = "uploads"

    @classmethod
    def read(cls, settings: Mapping[str, str], prefix: str = "LEDGERLOOM_") -> Options:
        """From names such as LEDGERLOOM_FINAL_K; other names are ignored, values that aren't of the field's kind fail."""
        found = {f.name: settings[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in settings}
        return cls(**{name: type(getattr(cls, name))(value) for name, value in found.items()})

    def retrieval(self) -> dict[str, float]:
        """Keyword arguments of ``retrieve.candidates``."""
        return {"k": self.final_k, "vector_k": self.vector_k, "lexical_k": self.lexical_k, "threshold": self.threshold}

    def grounding(self) -> dict[str, float]:
        """Keyword arguments of ``evidence.verified``."""
        return {"coverage": self.coverage}
