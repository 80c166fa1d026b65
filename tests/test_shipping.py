import io
import zipfile

from quireline import shipping


def test_archive_holds_the_package():
    names = zipfile.ZipFile(io.BytesIO(shipping.package_zip())).namelist()
    assert "quireline/__init__.py" in names and "quireline/functions/text.py" in names and all(n.endswith(".py") for n in names)
