"""What can go wrong, by kind."""


class MailError(Exception):
    pass


class NotFound(MailError):
    pass


class InvalidInput(MailError):
    pass


class MailParse(MailError):
    pass


class RateLimited(MailError):
    pass


class Duplicate(MailError):
    pass


class ModelUnavailable(MailError):
    pass
