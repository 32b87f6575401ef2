"""Operations of a training-data pipeline over tables of documents, pages and vectors.

Nothing outside this package imports it.  A row's identity is ``(doc_id, text)``: rows repeated in full count once
wherever an operator groups rows, and every operator says in its docstring what null, empty and very long texts give.
"""
