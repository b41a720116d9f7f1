"""What can be wrong with a script, a plan or a configuration."""


class SluiceError(Exception):
    """Any error of this engine."""


class PipelineError(SluiceError):
    """A script that can't be planned."""


class UnsupportedSqlError(PipelineError):
    """SQL outside the strict dialect; extended mode may take it."""


class UnsupportedExpression(UnsupportedSqlError):
    pass


class UnknownFunction(PipelineError):
    pass


class JoinError(PipelineError):
    pass


class SetError(PipelineError):
    pass


class WindowError(PipelineError):
    pass


class ConfigError(SluiceError):
    """A configuration with unknown keys, missing tables or sinks without a source."""


class ContractError(SluiceError):
    """The schema of a built pipeline is not the one in its lock file."""


class ChangelogError(SluiceError):
    """A change that contradicts the table it is applied to."""
