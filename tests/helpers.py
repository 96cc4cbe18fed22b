def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql, columns):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(columns), (names, columns)
    return [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]


def same(con, df, sql):
    columns, got = spark_rows(df)
    want = duck_rows(con, sql, columns)
    assert sorted(got, key=repr) == sorted(want, key=repr)
