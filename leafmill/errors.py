"""Error classes: raised on the driver in fail-fast use, else carried in ``error_class`` columns."""


class LeafmillError(Exception):
    """Base of all errors of this package."""


class UnreadableDocument(LeafmillError):
    """A source that no loader could read (damaged or encrypted)."""


class InputTooLarge(LeafmillError):
    """More pages, bytes or tokens than a limit allows."""


class BudgetExceeded(LeafmillError):
    """Recorded cost went over the budget."""


class PolicyHalt(LeafmillError):
    """A policy with the action ``halt`` matched."""
