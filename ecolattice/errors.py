"""Errors and warnings of the engine."""


class CalculationError(Exception):
    """Base class of the engine's errors."""


class OutsideTechnosphere(CalculationError):
    """A demanded product is not a row of the technosphere matrix."""


class EfficiencyWarning(RuntimeWarning):
    """Least squares was asked for although the technosphere is square."""


class NoSolutionFound(UserWarning):
    """The linear system has no acceptable solution."""


class NonsquareTechnosphere(CalculationError):
    """Numbers of products and activities differ."""


class MalformedFunctionalUnit(CalculationError):
    """A demand cannot be understood."""


class EmptyBiosphere(CalculationError):
    """Impact assessment needs elementary flows, and there are none."""


class AllArraysEmpty(CalculationError):
    """All arrays of a matrix are empty."""


class NoArrays(CalculationError):
    """A matrix has no arrays."""


class InconsistentGlobalIndex(CalculationError):
    """Characterization resources name different global locations."""


class MultipleValues(CalculationError):
    """One value was expected, and there are several."""


class InconsistentLCIA(CalculationError):
    """Normalizations or weightings don't fit the impact categories."""


class MissingDatabaseDependencies(CalculationError):
    """A package doesn't say which databases it depends on."""


class CyclicDependencyGraph(CalculationError):
    """Databases depend on each other in a circle."""


class StaticDependsOnStochastic(CalculationError):
    """A static database depends on a stochastic one."""


class DemandInStaticDatabase(CalculationError):
    """The demand lies in a static database."""


class SingularTechnosphere(CalculationError):
    """The technosphere matrix has no inverse."""


class UnsupportedDistribution(CalculationError):
    """The uncertainty type is not known."""
