"""Helpers of the tests; in a module of their own, so that no other folder's conftest can stand in for them."""


def rows(df):
    return [r.asDict() for r in df.collect()]
