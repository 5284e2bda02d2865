"""Errors of the library; all are ValueErrors."""

from __future__ import annotations


class EngineError(ValueError):
    """Base of all errors; context() adds what was being done."""

    def context(self, what: str) -> EngineError:
        self.args = (f"{what}: {self}", *self.args[1:])
        return self


class EmptyInput(EngineError): ...


class DimensionMismatch(EngineError):
    def __init__(self, expected, found):
        super().__init__(f"expected {expected}, found {found}")


class ShapeMismatch(DimensionMismatch): ...


class NonFinite(EngineError): ...


class InvalidParameter(EngineError): ...


class InvalidInput(EngineError): ...


class NotFitted(EngineError): ...


class NotConverged(EngineError): ...


class Computation(EngineError): ...


class NeuralNetworkError(EngineError): ...


class ForwardPassNotRun(NeuralNetworkError): ...


class TreeError(EngineError): ...


class ModelIoError(EngineError): ...


class ModelStructureMismatch(ModelIoError): ...


class UnsupportedModelFormat(ModelIoError): ...
