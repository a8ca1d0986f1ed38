"""Text between the rows of a table is visible text too."""

from slideframe.llm import html_text as ht


def test_strings_of_row_groups():
    assert ht.render("<table><tbody>note<tr><td>a</table>") == "note\na"
    assert ht.render("<table>x<thead>h<tr><th>a<tbody>b<tr><td>c<tfoot>f</table>") == "x h b f\na\nc"
    assert ht.render("<table><colgroup>note<col><tr><td>a</table>") == "note\na"
    assert ht.render("<table><tbody hidden>no<tr><td>n</tbody><tr><td>a</table>") == "a"
    assert ht.render("<table>\n<tbody>\n<tr><td>a</td></tr>\n</tbody>\n</table>") == "a"
