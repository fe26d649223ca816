"""Errors of rules."""


class RuleError(ValueError):
    """A rule, or the content that it is applied to, is malformed."""


class UnsupportedRule(RuleError):
    """A rule needs a capability that isn't there, such as a JavaScript engine."""
