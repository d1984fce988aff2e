"""A stand-in for an HTTP client: two pages per endpoint."""

import json


def fetch(endpoint, page_no):
    if page_no >= 2:
        return None
    return json.dumps({"results": [{"name": f"{endpoint}-{page_no}-{i}"} for i in range(3)]})


def counted(endpoint, page_no):
    """The same, three pages long; every call leaves a file beside the endpoint's name."""
    import uuid

    with open(f"{endpoint}-{page_no}-{uuid.uuid4().hex}.call", "w"):
        pass
    if page_no >= 3:
        return None
    if page_no == 1 and endpoint.endswith("cut"):
        return '{"results": [{"na'
    return json.dumps({"results": [{"name": f"{page_no}-{i}"} for i in range(4)]})
