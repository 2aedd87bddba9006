import datetime


def search(keyword):
    return [(f"{keyword}1", "title", "body", datetime.datetime(2024, 1, 1))]
