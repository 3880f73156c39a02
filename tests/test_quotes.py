from lodestone.operators.terminology import quotes_found


def test_quotes_of_any_length(spark):
    texts = [(1, "The rash is  sore and it won't\nheal by itself, they said to us all."), (2, "Rashes itch."), (3, None), (4, "A sore throat - is it? Yes.")]
    quotes = [(1, "rash is sore"), (2, "itch"), (3, "Rash"), (4, "ash is sore and it won't heal by itself, they said to u"), (5, "- is it?"), (6, ""), (7, None), (8, "sore and heal"), (9, "sore"), (10, "?"), (11, "won't heal by itself")]
    q, t = spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(texts, "text_id int, text string")
    flat = lambda x: " ".join(x.split())
    want = {(a, b) for a, x in quotes for b, y in texts if x and y and flat(x) in flat(y)}
    assert {tuple(r) for r in quotes_found(q, t).collect()} == want
    assert quotes_found(q.limit(0), t).count() == 0
