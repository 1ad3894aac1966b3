"""What can be wrong with a document. Conversion turns these into rows, never into failed tasks."""


class ConversionError(Exception):
    """``code`` names the kind of trouble; the message says more."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


def reject(code: str, message: str = "") -> None:
    raise ConversionError(code, message)
