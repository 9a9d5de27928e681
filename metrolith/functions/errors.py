"""Errors that say by a code why a plan is refused."""


class PlanError(ValueError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
